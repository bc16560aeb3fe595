"""Token counts by a unigram model, with the forward scores of shared prefixes computed once.

A text's pre-tokens are its words with the word mark before them. The distinct pre-tokens of a batch are
inserted in a trie in sorted order, which walks the trie depth first: the path to the last word stays on a
stack, and a new word only computes the nodes below the prefix that it shares. A node holds the best
forward score of its prefix and the number of pieces on that path; a word's end stores its count, and
stored counts of earlier batches are used again.

Scores: a vocabulary file of ranked pieces has no probabilities, so a piece of rank r is given the
log-probability of Zipf's law, -log(r + 1) - log(H), with H the harmonic sum over all pieces. A character
that no piece covers costs one piece a byte, each at the score of a rank behind all others. Of paths of
equal score the one with fewer pieces counts.

No shuffle: each text is counted where it is read. A null or empty text has no tokens; texts of any
length are counted whole; repeated rows stay repeated; null doc_ids are kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from findery.llm.common import Memo, slices, texts

MARK = "▁"
SCHEMA = "doc_id long, n_words long, n_tokens long, log_score double"


def piece_scores(pieces: list[str]) -> tuple[dict[str, float], float]:
    """The scores of ranked pieces, and that of an uncovered byte."""
    harmonic = math.log(sum(1 / r for r in range(1, len(pieces) + 2)))
    return {p: -math.log(r + 1) - harmonic for r, p in reversed(list(enumerate(pieces)))}, -math.log(len(pieces) + 1) - harmonic


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, best first."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(model.vocab_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i)))
    return [model.id_to_piece(i) for i in sorted(ids, key=lambda i: (-model.get_score(i), i))]


class ForwardTrie:
    def __init__(self, pieces: list[str]) -> None:
        self.scores, self.byte = piece_scores(pieces)
        # By its last character: the lengths of pieces that end in it, so that few are tried.
        ends: dict[str, set[int]] = {}
        for piece in pieces:
            ends.setdefault(piece[-1], set()).add(len(piece))
        self.ends = {c: sorted(lengths) for c, lengths in ends.items()}
        self.counts = Memo(self._insert)

    def _insert(self, words: list[bytes]) -> Iterator[tuple[int, float]]:
        """Terminal (count, score) of sorted words. path[i] is the node of the first i characters of the
        last word, as (forward score, -pieces)."""
        last, path = "", [(0.0, 0)]
        scores, ends, byte = self.scores, self.ends, self.byte
        for raw in words:
            word = MARK + raw.decode()
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                char = word[end - 1]
                width = len(char.encode())
                score, pieces = path[end - 1]
                best = (score + width * byte, pieces - width)
                for length in ends.get(char, ()):
                    if length > end:
                        break
                    own = scores.get(word[end - length : end])
                    if own is not None:
                        score, pieces = path[end - length]
                        other = (score + own, pieces - 1)
                        if other > best:
                            best = other
                path.append(best)
            last = word
            yield -path[-1][1], path[-1][0]

    def count(self, cut: list[list[bytes]]) -> list[tuple[int, float]]:
        found = self.counts.lookup(cut)
        return [(sum(x[0] for x in ends), math.fsum(x[1] for x in ends)) for ends in found]


@lru_cache(maxsize=2)
def trie(path: str) -> ForwardTrie:
    return ForwardTrie(vocabulary(path))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens, log_score) of every text: its words, the pieces on their best paths,
    and the summed score of those paths. `path` is a sentencepiece model whose pieces are ranked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = trie(path)
        for batch in batches:
            for part in slices(batch):
                cut = [t.encode().split() for t in part.column("text").to_pylist()]
                found = counter.count(cut)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(words) for words in cut], pa.int64()),
                        pa.array([x[0] for x in found], pa.int64()),
                        pa.array([x[1] for x in found], pa.float64()),
                    ],
                    ["doc_id", "n_words", "n_tokens", "log_score"],
                )

    return texts(docs).mapInArrow(run, SCHEMA)
