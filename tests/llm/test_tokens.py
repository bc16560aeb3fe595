"""Token files, token counts and byte-level BPE against plain versions."""

import base64
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers as tokens
import pyarrow as pa
import pytest
import tiktoken
from llm.cases import awkward, empty
from tokenizers import Tokenizer

from findery.llm import byte_bpe, token_counts, token_files

RANKS, WORDS, PIECES = (tokens.path(n) for n in ("byte_bpe_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"))


def given(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def all_docs(spark, sf_dir):
    return given(spark, sf_dir).unionByName(awkward(spark).select("doc_id", "text"))


def test_byte_bpe_equals_tiktoken(spark, all_docs):
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for doc_id, text in all_docs.collect():
        ids = plain.encode_ordinary(text or "")
        raw = np.array(ids, "<u4").tobytes()
        want.append((doc_id, len(ids), ids, hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = [tuple(r) for r in byte_bpe.encode_decode(all_docs, RANKS, tokens.PATTERN).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_token_files_equal_the_tokenizer(spark, all_docs, tmp_path):
    plain = Tokenizer.from_file(WORDS)
    plain.encode_special_tokens = True
    rows = sorted(((r[0], r[1] or "") for r in all_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for doc_id, text in rows:
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    token_files.write_tokens(all_docs, str(tmp_path / "t"), WORDS, 2)
    read = token_files.read_tokens(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, token_files.digests(read).collect()), key=repr) == sorted(want, key=repr)
    found = read.where("doc_id = 7").collect()
    assert [(r.doc_id, r.ids) for r in found if r.n_tokens == 1] == [(7, [2])]


def test_a_lookup_reaches_the_scan(spark, all_docs, tmp_path):
    token_files.write_tokens(all_docs, str(tmp_path / "t"), WORDS, 2)
    one = token_files.read_tokens(spark, str(tmp_path / "t")).where("doc_id = 7")
    assert "EqualTo(doc_id,7)" in one._jdf.queryExecution().executedPlan().toString()


def slow_count(word, scores, byte):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        width = len(word[end - 1].encode())
        paths = [(best[end - 1][0] + width * byte, best[end - 1][1] - width)]
        paths += [
            (best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(max(0, end - 64), end) if word[s:end] in scores
        ]
        best.append(max(paths))
    return -best[-1][1], best[-1][0]


def test_counts_equal_a_plain_forward_pass(spark, all_docs):
    scores, byte = token_counts.piece_scores(token_counts.vocabulary(PIECES))
    known = {}
    want = []
    for doc_id, text in all_docs.collect():
        words = (text or "").encode().split()
        for w in set(words) - set(known):
            known[w] = slow_count("▁" + w.decode(), scores, byte)
        want.append((doc_id, len(words), sum(known[w][0] for w in words), math.fsum(known[w][1] for w in words)))
    got = [tuple(r) for r in token_counts.token_counts(all_docs, PIECES).collect()]
    for a, b in zip(sorted(got, key=repr), sorted(want, key=repr), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3])


def test_empty_tables(spark, tmp_path):
    none = empty(spark)
    assert byte_bpe.encode_decode(none, RANKS, tokens.PATTERN).count() == 0
    assert token_counts.token_counts(none, PIECES).count() == 0
    token_files.write_tokens(none, str(tmp_path / "t"), WORDS, 2)
    assert token_files.digests(token_files.read_tokens(spark, str(tmp_path / "t"))).count() == 0


def test_word_parts_equal_the_whole_tokenizer():
    """Punctuation behind words, apostrophes, marks, capitals beyond ASCII, digits and other scripts."""
    plain = Tokenizer.from_file(WORDS)
    plain.encode_special_tokens = True
    words = ["don't,", "it's", "x's.", "café!!", "café,", "ÉTÉ.", "Straße;", "a1b2,", "1,000.50", "…,", "x…,", "日本。", "日本,", "'s,", "''", "!!",
             "ﬁn,", "ǅ.", "Σας,", "i̇,", "İ,", "<|endoftext|>", "a_b_", "é", "-", "\x1f,", "a\x1f,", "naïve?)", "x'", "x',y", "ŉ.", "ª,", "²,", "Ⅷ,"]
    texts = words + [" ".join(words), " ".join(words[::-1]), "", " \n"]
    sizes, ids = token_files.WordIds(WORDS).encode(pa.array(texts))
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(x) for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_caches_share_one_budget(monkeypatch):
    from findery.llm.common import Memo

    monkeypatch.setattr(Memo, "room", 1_000_000)
    first, second = Memo(lambda ws: [w * 2 for w in ws]), Memo(lambda ws: [w * 3 for w in ws])
    for memo, times in ((first, 2), (second, 3), (first, 2)):
        for start in range(0, 20_000, 500):
            words = [b"%d" % i for i in range(start, start + 500)]
            assert memo.lookup([words, words[:3]]) == [[w * times for w in words], [w * times for w in words[:3]]]
            assert first.held + second.held <= 1_000_000
    assert first.held > 0 and len(second.known) == 0
