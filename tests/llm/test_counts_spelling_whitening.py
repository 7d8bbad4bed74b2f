"""Token counts, spelling variants and whitening against the library, brute force and NumPy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SF_MID, SF_SMALL
from test_texts import rows_of
from tokenizers import Tokenizer

from scorewatch.llm import spelling, tokencounts, whitening

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def library_counts(texts, path=BYTE):
    if path.endswith(".model"):
        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("where", ["edge", SF_MID])
def test_counts_query(spark, edge_dir, where):
    d = edge_dir if where == "edge" else where
    docs = rows_of(spark, d)
    n = library_counts([t or "" for _, t in docs])
    want = Counter((i, len((t or "").encode()), k, k > 1024) for (i, t), k in zip(docs, n, strict=True))
    assert Counter(map(tuple, tokencounts.q_counts(spark, d).collect())) == want


def odd_texts(n=400):
    rnd = random.Random(3)
    signs = ["a", "Zb", "don't", "'s", "12", "3.5", ",", "...", " ", "  ", "\n", "\n\n", "\t", " ", "\u0085", "\x1c", "é", "日本", "<|endoftext|>", " <|endoftext|>", "　", "🙂", "x."]
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_of_odd_texts_with_small_tables(spark, monkeypatch, name):
    monkeypatch.setattr(tokencounts, "FREQUENT", 5)
    monkeypatch.setattr(tokencounts, "KEPT", 3)
    path, texts = public_tokenizers.path(name), odd_texts()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(3)
    got = {r.row.doc_id: r.n_tokens for r in tokencounts.counted(docs, path).collect()}
    assert [got[i] for i in range(len(texts))] == library_counts(texts, path)


def test_length_table_finds_what_it_holds():
    parts = [f"part{i}" for i in range(5000)]
    t = tokencounts.LengthTable(tokencounts.digests(parts), np.arange(1, 5001, dtype=np.uint32))
    assert t.find(tokencounts.digests([*parts, "no", "none"])).tolist() == [*range(1, 5001), 0, 0]
    assert tokencounts.LengthTable(tokencounts.digests([]), np.zeros(0, np.uint32)).find(tokencounts.digests(["a"])).tolist() == [0]


def test_frequent_parts_are_the_frequent_ones(spark, monkeypatch):
    monkeypatch.setattr(tokencounts, "SUMMARY", 50)
    monkeypatch.setattr(tokencounts, "FREQUENT", 3)
    texts = [" ".join(["w", "often often often more more", *(f"r{i}x{j}" for j in range(20))]) for i in range(200)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    assert tokencounts.frequent_parts(docs)[:2] == [" often", " more"]


def test_counts_of_nothing(spark, empty_dir):
    out = tokencounts.q_counts(spark, empty_dir)
    assert out.count() == 0 and out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(docs):
    counts = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 7:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def variants(words):
    """Near words by all single edits that stand in the table, or all pairs where it is small."""
    near = {w: set() for w in words}
    masked = {}
    for w in words:
        for k in range(len(w)):
            masked.setdefault(w[:k] + "*" + w[k + 1:], []).append(w)
            shorter = w[:k] + w[k + 1:]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in masked.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-words[x], x))
            if words[best] >= 10 * words[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return Counter((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


@pytest.mark.parametrize("where", ["edge", SF_MID])
def test_spelling_query(spark, edge_dir, where):
    d = edge_dir if where == "edge" else where
    got = Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.q_spelling(spark, d).collect())
    assert got == variants(words_of(rows_of(spark, d)))


def close_words(n=900):
    rnd, out = random.Random(8), {}
    for _ in range(n // 6):
        w = "".join(rnd.choice("abé") for _ in range(rnd.randint(7, 10)))
        for _ in range(6):
            k, c = rnd.randrange(len(w)), rnd.choice("abé")
            out[w] = int(10 ** rnd.uniform(0.4, 4))
            w = rnd.choice([w[:k] + w[k + 1:], w[:k] + c + w[k:], w[:k] + c + w[k + 1:]])
            w += "a" * (7 - len(w))
    out.update({"a" * 3000: 5, "a" * 3001: 60, "a" * 1500 + "b" + "a" * 1500: 7, "a" * 2999 + "b": 9})
    return out


@pytest.mark.parametrize("tile, block", [(4096, 128), (9, 4)])
def test_near_words_in_dealt_groups(spark, monkeypatch, tile, block):
    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling, "BLOCK", block)
    words = close_words()
    pairs = {w: {x for x in words if x != w and abs(len(x) - len(w)) < 2 and one_edit(w, x)} for w in words}
    want = {(w, len(x), min((-words[o], o) for o in x)) for w, x in pairs.items() if x}
    out = spelling.near(spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)).collect()
    assert {(r.word, r.n_near, tuple(r.best)) for r in out} == want and len(out) == len(want)


def test_roots_of_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(19)] + [("x", "w7")]
    out = spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()
    assert {(r.word, r.root) for r in out} == {(w, "w19") for w, _ in chain}


def test_spelling_of_nothing(spark, empty_dir):
    assert spelling.q_spelling(spark, empty_dir).count() == 0


def plain_whitening(vectors, most=16):
    """(deviations, whitened, explained) by exact integers and eigh."""
    width = max(map(len, vectors))
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    dev = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    c = np.array([[n * a - b for a, b in zip(r, s, strict=True)] for r in fit], object)
    v = np.array([[float(y) for y in r] for r in c.T.dot(c) / n**3])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    y = np.array([[float(n * a - b) / n for a, b in zip(r, s, strict=True)] for r in x])
    return n, dev, y @ q / np.sqrt(e), e / np.trace(v)


def check_whitening(rows, vectors, most=16):
    n, dev, want, explained = plain_whitening(list(vectors.values()), most)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, []).append(r)
    assert got.keys() == vectors.keys()
    k = len(explained)
    white = np.zeros((len(vectors), k))
    for a, (i, d) in enumerate(zip(vectors, dev, strict=True)):
        mine = sorted(got[i], key=lambda r: r.component)
        assert [r.component for r in mine] == list(range(1, k + 1))
        assert {(r.n, r.deviation, r.deviation_digits) for r in mine} == {(n, d if d < 2**63 else None, str(d))}
        white[a] = [r.whitened for r in mine]
        assert np.allclose([r.explained for r in mine], explained, rtol=1e-6)
        assert max(r.identity_error for r in mine) < 1e-6
    signs = np.sign((white * want).sum(axis=0))
    assert np.allclose(white, want * signs, rtol=1e-6, atol=1e-6)


def test_whitening_query(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()}
    check_whitening(whitening.q_whitening(spark, SF_SMALL).collect(), vectors)


def test_whitening_leaves_out_what_takes_no_part(spark):
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(60, 5))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)] + [(100, [float(c) for c in base[0]]), (101, [0.5, -0.25]), (102, [0.5, -0.25, 0.0, 0.0, 0.0]), (103, [])]
    bad = [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [1.0, float("nan"), 0.0, 0.0, 0.0]), (203, [float("inf")] * 5)]
    df = spark.createDataFrame([(i, v, 1, "a") for i, v in rows + bad], "vec_id long, embedding array<double>, component int, key string").repartition(3)
    out = whitening.whitened(df).select("row.vec_id", "component", "n", "deviation", "deviation_digits", "whitened", "explained", "identity_error", "row.key")
    rows_out = out.collect()
    assert {r.key for r in rows_out} == {"a"}
    check_whitening(rows_out, dict(rows))


def test_whitening_of_entries_of_any_size(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rnd.normal(size=(40, 4)))]
    large = [*rows, (50, [3e38, 0.0, 1.0, -2.0])]
    out = whitening.whitened(spark.createDataFrame(large, "vec_id long, embedding array<double>")).select("row.vec_id", "component", "n", "deviation", "deviation_digits", "whitened", "identity_error")
    got = out.collect()
    assert len(got) == 41 * 4 and max(r.identity_error for r in got) < 1e-6
    _, dev, _, _ = plain_whitening([v for _, v in large])
    assert {(r.vec_id, r.deviation_digits) for r in got} == {(i, str(d)) for (i, _), d in zip(large, dev, strict=True)}


def test_whitening_without_variance(spark, empty_dir):
    assert whitening.q_whitening(spark, empty_dir).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whitened(same).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whitened(line).collect()} == {1}


@pytest.mark.parametrize("size", [3, 10**4, 2**45, 2**70])
def test_cross_products_are_exact(size):
    rnd = random.Random(size)
    u = np.array([[rnd.randrange(size) for _ in range(4)] for _ in range(150)], np.int64 if size < 2**40 else object)
    want = [[sum(int(a) * int(b) for a, b in zip(u[:, i], u[:, j], strict=True)) for j in range(4)] for i in range(4)]
    assert whitening.cross_products(u).tolist() == want
    y = u.astype(object) - size // 2
    s, c = whitening.block_sums(np.array(y, float)) if size < 2**50 else (y.sum(axis=0), y.T.dot(y))
    assert list(s) == list(y.sum(axis=0)) and (c == y.T.dot(y)).all()


def test_limbs_add_up():
    for v in (0, 1, -1, 2**32, -(2**32), 2**64 - 1, -(10**40), 12345678901234567890):
        assert sum(x << whitening.LIMB * k for k, x in whitening.limbs(v)) == v
