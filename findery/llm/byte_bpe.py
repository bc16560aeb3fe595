"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The model is written straight from the vocabulary: each token's bytes become one printable character
a byte, a piece's score is its negative rank, and the normaliser is the identity. sentencepiece then
merges the best-scored neighbours first, which is the order of the ranks. Texts are cut into pre-tokens
by the tokenizer's pattern and each pre-token is encoded on its own; decoding maps a piece's characters
back to bytes.

Encoding needs no shuffle: every text is encoded where it is read. A null text is an empty one and has
no tokens; a text of any length is encoded whole; repeated rows stay repeated; null doc_ids are kept; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from findery.llm.common import Memo, slices, texts

SCHEMA = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string"

#: A cut before a space is a border of pre-tokens unless white space or the end follows it.
_UNSURE = re.compile(r" (?:\s|\Z)")
_CHUNK = regex.compile(r"\s*\S+|\s+")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def model_proto(tokens: list[bytes]) -> bytes:
    """A sentencepiece model: piece i is token i, scored -i; the unknown piece comes last.

    Field numbers are those of sentencepiece_model.proto: a model has pieces (1), a trainer's spec (2)
    with model_type (3; 2 is BPE), and a normaliser's spec (3) with a name (1) and three switches (3-5).
    """
    chars = byte_characters()
    pieces = [(("".join(chars[b] for b in token)), -float(i), 1) for i, token in enumerate(tokens)]
    pieces.append(("<unk>", 0.0, 2))
    body = b"".join(
        _message(1, _message(1, piece.encode()) + b"\x15" + np.float32(score).tobytes() + _number(3, kind))
        for piece, score, kind in pieces
    )
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(tokens))
    identity = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return body + _message(2, trainer) + _message(3, identity)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class ByteBpe:
    def __init__(self, path: str, pattern: str) -> None:
        self.tokens = read_ranks(path)
        self.rank = {token: i for i, token in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.tokens))
        self.pattern = regex.compile(pattern)
        chars = byte_characters()
        self.char = {b: c for b, c in enumerate(chars)}
        back = {c: b for b, c in enumerate(chars)}
        self.back = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(self.tokens))]
        self.pretokens = Memo(self._encode_pretokens)
        self.words = Memo(lambda words: self._encode_chunks([" " + w for w in words]))

    def _encode_pretokens(self, pretokens: list[str]) -> Iterator[bytes]:
        """Whole tokens keep their own rank, as the merges might not reach it; others are merged."""
        raw = [p.encode() for p in pretokens]
        rest = [i for i, p in enumerate(raw) if p not in self.rank]
        mapped = [raw[i].decode("latin-1").translate(self.char) for i in rest]
        merged = dict(zip(rest, self.model.encode(mapped, num_threads=1) if mapped else [], strict=True))
        for i, p in enumerate(raw):
            yield array("I", merged[i] if i in merged else [self.rank[p]]).tobytes()

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        return list(map(b"".join, self.pretokens.lookup([self.pattern.findall(chunk) for chunk in chunks])))

    def encode(self, many: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian 32-bit integers.

        A pre-token never holds something else followed by white space, so a text may be cut before a
        single space: its words are looked up one by one, and only new words go through the pattern.
        """
        fast = [_UNSURE.search(t) is None for t in many]
        cut = [t.split(" ") if ok else [] for t, ok in zip(many, fast, strict=True)]
        heads = [c[0:1] if ok else _CHUNK.findall(t) for t, c, ok in zip(many, cut, fast, strict=True)]
        flat = iter(self._encode_chunks([h for head in heads for h in head]))
        words = self.words.lookup([c[1:] for c in cut])
        return [b"".join([next(flat) for _ in head] + found) for head, found in zip(heads, words, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.back.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every text.

    `path` is a rank file and `pattern` the pre-token pattern. The hashes are of the ids as
    little-endian unsigned 32-bit integers and of the bytes that the ids decode to.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = bpe.encode(part.column("text").to_pylist())
                sizes = np.array([0, *(len(x) // 4 for x in ids)]).cumsum()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(sizes), pa.int64()),
                        pa.ListArray.from_arrays(
                            pa.array(sizes, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"))
                        ),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                )

    return texts(docs).mapInArrow(run, SCHEMA)
