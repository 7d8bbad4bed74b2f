"""Token operators against the libraries on whole texts."""

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from conftest import SF_SMALL
from tokenizers import Tokenizer

from scorewatch.llm import encoders, huffman, packing, pieces


def library(name, texts):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.encode_special_tokens = True
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def rows_of(spark, d):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("where", ["edge", SF_SMALL])
def test_huffman_query(spark, edge_dir, where):
    d = edge_dir if where == "edge" else where
    docs = rows_of(spark, d)
    ids = [[*x, 2] for x in library("word_bpe_49k.json", [t or "" for _, t in docs])]
    got = huffman.q_huffman(spark, d).collect()
    key = lambda i: (i is not None, i or 0)
    assert sorted([(key(i), len(x), crc(x)) for (i, _), x in zip(docs, ids, strict=True)]) == sorted((key(r.doc_id), r.n_tokens, r.ids_crc32) for r in got)
    total = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == total
        total += r.n_tokens
    assert [key(r.doc_id) for r in sorted(got, key=lambda r: r.start)] == sorted(key(i) for i, _ in docs)


def test_code_is_optimal_and_limited():
    rng = np.random.default_rng(3)
    for n, limit in ((1, 4), (2, 4), (9, 4), (16, 4), (300, 9), (300, 16)):
        counts = (rng.pareto(0.3, n) * 10).astype(np.int64) % 10**9 + 1
        lengths = huffman.code_lengths(counts, limit)
        assert lengths.max() <= limit and (2.0**-lengths).sum() <= 1
        code = huffman.Code(np.arange(n) * 3, lengths)
        ids = rng.choice(np.arange(n) * 3, 1000, p=counts / counts.sum())
        for k in (1, 127, 128, 129, 1000):
            bits, runs = code.encode(ids[:k])
            assert (code.decode(bits, runs, k) == ids[:k]).all()
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(17, np.int64), 4)
    # Without a binding limit the lengths are Huffman's.
    counts = np.array([5, 9, 12, 13, 16, 45])
    assert (huffman.code_lengths(counts, 16) * counts).sum() == 224


def test_pieces_query(spark, edge_dir):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, t in rows_of(spark, edge_dir):
        ids = [*sp.encode(t or ""), sp.eos_id()]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = [tuple(r)[:4] for r in pieces.q_pieces(spark, edge_dir).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_spans_cover_the_text(spark, edge_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [t or "" for _, t in rows_of(spark, edge_dir)]
    counts, ids, lo, hi = pieces.encode_with_spans(path, pa.array(texts))
    slow = pieces.Normaliser(open(path, "rb").read())
    p = pieces._pieces(path)
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        norm, source = slow(t)
        begin = 0
        for k in range(at, at + n):
            end = begin + int(p.length[ids[k]])
            assert (source[begin], source[end] if end < len(norm) else len(t.encode())) == (lo[k], hi[k])
            begin = end
        at += n


def test_character_map_normalisation():
    norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    own = pieces.Normaliser(norm.serialized_model_proto())
    for t in ("ﬁne ①２ ㍿  x", "  lead and trail  ", "カﾞ ｶﾞ a\tb\nc", "", "   ", "plain", "Å é é", "​zero"):
        text, offsets = norm.normalize(t, with_offsets=True)
        got, source = own(t)
        assert got.decode() == text
        raw = t.encode()
        assert all(0 <= s <= len(raw) for s in source) and source == sorted(source)


def test_packing_query(spark, edge_dir):
    docs = rows_of(spark, edge_dir)
    ids = [[*x, 0] for x in library("byte_bpe_50k.json", [t or "" for _, t in docs])]
    want = []
    for (i, _), x in zip(docs, ids, strict=True):
        first = len(x) - (math.ceil(len(x) / 2048) - 1) * 2048
        cuts = [0, *range(first, len(x) + 1, 2048)]
        want += [(i, k, a, b - a, crc(x[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = packing.q_packing(spark, edge_dir).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    check_sequences(got, sum(map(len, ids)))


def check_sequences(got, tokens, most=1.03):
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= most * math.ceil(tokens / 2048) + 1


@pytest.mark.parametrize("range_rows", [10**6, 50])
def test_placing_is_dense(spark, range_rows):
    rnd = np.random.default_rng(8)
    lengths = np.concatenate([rnd.integers(1, 2047, 400), rnd.integers(1, 60, 300), [700] * 60, [1]]).tolist()
    docs = spark.createDataFrame(list(enumerate(lengths)), "pid long, length long")
    got = packing.place(docs, range_rows=range_rows).collect()
    assert sorted(r.pid for r in got) == list(range(len(lengths)))
    rows = [type("R", (), {"sequence_id": r.sid, "offset": r.place, "length": lengths[r.pid]}) for r in got]
    check_sequences(rows, sum(lengths), 1.04)


def test_ranks_settle_across_ranges():
    spans, rest = packing._settle({(0, "gap"): 3, (1, "doc"): 2, (1, "gap"): 1, (2, "doc"): 4, (3, "doc"): 1})
    assert spans == [(1, 0, 0, 0, 2), (2, 0, 1, 0, 1), (2, 1, 0, 2, 1)] and rest == {2: 2, 3: 1}


def test_empty(spark, empty_dir):
    for q in (huffman.q_huffman, pieces.q_pieces, packing.q_packing):
        assert q(spark, empty_dir).count() == 0


def test_encoder_starts_anew_when_full():
    path = public_tokenizers.path("word_bpe_49k.json")
    enc = encoders.Encoder(encoders.Library(path, lower=True).parts)
    want = library("word_bpe_49k.json", ["alpha beta."])[0]
    for _ in range(2):
        n, ids = enc.gather(enc.entry(["alpha", "beta", "."]), np.array([3]))
        assert ids.tolist() == want and n.tolist() == [len(want)]
        enc.clear()
