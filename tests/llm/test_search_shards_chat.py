"""Top-k search, shards, URL filter and chat examples."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF_MID, SF_SMALL
from pyspark.sql import functions as F

from scorewatch.llm import chat, mtree, sharding, urls


def best(rows, k, is_query):
    """Brute force over (vec_id, integers or None)."""
    rows = [(i, [int(x) for x in v]) for i, v in rows if i is not None and v is not None]
    dim = max((len(v) for _, v in rows), default=0)
    x = np.array([v + [0] * (dim - len(v)) for _, v in rows], np.int64).reshape(len(rows), dim)
    ids, out = [i for i, _ in rows], []
    for q, i in enumerate(ids):
        if is_query(i):
            score = x @ x[q]
            order = sorted((-int(score[c]), ids[c], c) for c in range(len(ids)) if c != q)[:k]
            out += [(i, r + 1, c, -s) for r, (s, c, _) in enumerate(order)]
    return Counter(out)


@pytest.mark.parametrize("tree_rows", [30, 4096])
def test_search_is_exact(spark, tree_rows):
    rng = np.random.default_rng(6)
    centres = rng.integers(-40, 40, (8, 12))
    x = [(int(i), (centres[i % 8] + rng.integers(-6, 7, 12)).tolist()) for i in range(500)]
    x += [(1000 + i, [9] * 12) for i in range(300)] + [(2000, []), (2001, [3]), (2050, [0] * 12), (2100, [50, -50]), (None, [1] * 12), (1000, [8] * 12)]
    df = spark.createDataFrame(x, "vec_id long, v array<long>").where("vec_id is not null").repartition(6)
    forest = mtree.Forest(df, F.col("vec_id") % 50 == 0, tree_rows=tree_rows, max_pivots=5)
    got = Counter(tuple(r) for r in forest.search(5).collect())
    assert got == best(x, 5, lambda i: i % 50 == 0)


def test_pages_bound_their_subtrees(spark):
    df = mtree.integers(spark.read.parquet(f"{SF_SMALL}/embeddings.parquet"))
    forest = mtree.Forest(df, F.lit(False), tree_rows=10**6)
    tree = mtree.Tree(forest.dim)
    for r in forest.pages.collect():
        tree.add(r.page, r.leaf, *[bytes(r[c]) for c in ("vectors", "to_parent", "radius", "norm", "least", "ref")])

    def rows(number, parent):
        leaf, x, to_parent, radius, norm, least, ref = tree.pages[number]
        if parent is not None:
            assert np.allclose(to_parent, mtree.distances(x, parent))
        if leaf:
            return x, least
        below = []
        for k in range(len(x)):
            sub, ids = rows(int(ref[k]), x[k])
            assert mtree.distances(sub, x[k]).max() <= radius[k] and (sub**2).sum(1).max() == norm[k] and ids.min() == least[k]
            below.append((sub, ids))
        return np.concatenate([a for a, _ in below]), np.concatenate([b for _, b in below])

    assert len(tree.pages) > 3 and sorted(rows(0, None)[1].tolist()) == sorted(r.vec_id for r in df.collect())


def test_search_skips_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 1.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (None, [1.0, 1.0]), (5, [0.001, -0.001]), (50, [-1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, tree string, rid int")
    got = Counter(tuple(r) for r in mtree.Forest(mtree.integers(df), F.col("vec_id") % 50 == 0).search(5).collect())
    assert got == best([(0, [128, 256]), (5, [0, -1]), (50, [-256, 512])], 5, lambda i: i % 50 == 0)


@pytest.mark.parametrize("tree_rows", [20, 4096])
def test_components_of_any_size_are_scored_exactly(spark, tree_rows):
    rnd = np.random.default_rng(4)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rnd.normal(size=(90, 6)) * 3e7)]
    rows += [(200 + i, [3e7, -2e7, 1e-3 * i, 5.0, 0.0, 1.0]) for i in range(30)]  # scores that differ in the last digits
    large = [(500, [1e30, 1.0]), (550, [-1e30, 2.0]), (600, [1e30, 1.0, 3.0]), (650, [2.0**1020])]
    df = spark.createDataFrame(rows + large, "vec_id long, embedding array<double>").repartition(3)
    got = mtree.Forest(mtree.integers(df), F.col("vec_id") % 10 == 0, tree_rows=tree_rows).search(5).collect()
    whole = {i: [math.floor(256 * c) for c in v] + [0] * (6 - len(v)) for i, v in rows + large[:3]}
    want = set()
    for q in (i for i in whole if i % 10 == 0):
        score = {c: sum(a * b for a, b in zip(whole[q], whole[c], strict=True)) for c in whole if c != q}
        best = sorted(score, key=lambda c: (-score[c], c))[:5]
        want |= {(q, r + 1, c, score[c] if abs(score[c]) < 2**63 else None) for r, c in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_sort_keys_sort_like_numbers():
    numbers = sorted({0, 1, -1, 9, 10, -9, -10, 2**63, -(2**63), 10**80, -(10**80), 123, -123, 124, -124})
    assert sorted(numbers, key=mtree.sort_key) == numbers


@pytest.mark.parametrize("bucket_bytes", [sharding.BUCKET_BYTES, 20_000])
def test_shards(spark, edge_dir, bucket_bytes):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet").select("doc_id", "text", F.lit(99).alias("slot"), F.lit("x").alias("bucket"))
    docs = docs.unionByName(docs.where("doc_id = 1").crossJoin(spark.range(400)).select(*docs.columns))
    rows = docs.collect()
    out = sharding.sharded(docs, 24, bucket_bytes=bucket_bytes)
    got = out.collect()
    assert Counter((r.row.doc_id, r.text, r.row.slot, r.row.bucket) for r in got) == Counter((r.doc_id, r.text, 99, "x") for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    for parts in (2, 5):  # the order does not depend on how the input is split
        again = sharding.sharded(docs.repartition(parts), 24, bucket_bytes=bucket_bytes).collect()
        assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    other = sharding.sharded(docs, 24, seed=5, bucket_bytes=bucket_bytes).collect()
    assert Counter(map(tuple, other)) != Counter(map(tuple, got))


def test_equal_rows_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPY_BLOCK", 4)
    rows = [(1, "a")] * 11 + [(1, "b")] * 2 + [(None, None)] * 3 + [(2, "c"), (3, "c")]
    out = sharding.numbered(sharding.bundled(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))).collect()
    assert sorted((str(r.row.doc_id), str(r.text), r["copy"]) for r in out) == sorted(
        [("1", "a", i) for i in range(11)] + [("1", "b", 0), ("1", "b", 1)] + [("None", "None", i) for i in range(3)] + [("2", "c", 0), ("3", "c", 0)])


def test_shards_by_the_plain_order(spark):
    """Each bucket holds its rows in the order of a seeded permutation of their sorted keys; shards cut that order."""
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat(CAST(id AS string), 40) AS text")
    keyed = sharding.scatter(sharding.bundled(docs), 8, sharding.SEED).collect()
    order = []
    for k in range(8):
        mine = sorted((r.key, r.row.doc_id) for r in keyed if r.bucket == k)
        order += [mine[i][1] for i in np.random.Generator(np.random.PCG64([sharding.SEED, k])).permutation(len(mine))]
    got = sorted((r.shard, r.slot, r.row.doc_id) for r in sharding.sharded(docs, 7).collect())
    assert [i for *_, i in got] == order


def test_shards_are_shuffled(spark):
    got = sharding.sharded(spark.range(4000).selectExpr("id AS doc_id", "CAST(id AS string) AS text").repartition(3), 4, bucket_bytes=60_000).orderBy("shard", "slot").collect()
    ids = np.array([r.row.doc_id for r in got])
    assert abs(np.corrcoef(np.arange(len(ids)), ids)[0, 1]) < 0.06
    assert all(abs(np.mean([r.row.doc_id for r in got if r.shard == s]) - 2000) < 200 for s in range(4))


def test_sharding_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = sharding.q_sharding(spark, SF_SMALL).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in docs.items()}
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):], re.S)[0]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=(0, None, None))[1:]


ODD_URLS = [None, "", "no scheme", "HTTP://A.EXAMPLE.Net/en/x", "http://net/", "http://net", "http://xnet/", "http://example.com/de", "https://b.example.com/de/?a=b&c", "http://x.org?q=/fr/",
            "http://x.org/fr/#y", "ftp://user@h.org:8/fr/p", "a://b://c.net/", "http://ÀÉ.net/é", "http://e.net/a\nb?c", "//x.net/", "http://h/" + "a/" * 20_000]


def test_url_query(spark, tmp_path):
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{SF_MID}/pages.parquet").collect()] + [(9000 + i, u) for i, u in enumerate(ODD_URLS)] + [(None, "http://x.org/fr/1")] * 2
    spark.createDataFrame([(*p, "h", "r") for p in pages], "page_id long, url string, host string, rule string").write.parquet(f"{tmp_path}/pages.parquet")
    got = urls.q_urls(spark, str(tmp_path)).collect()
    want = Counter((i, *plain_parts(u), plain_rule(*plain_parts(u))[0]) for i, u in pages)
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
    for r in got:
        verdict = plain_rule(r.host, r.path)[1]
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_url_trees_learn(spark):
    """Held-out accuracy on urls whose label no rule word gives away."""
    rng = np.random.default_rng(1)

    def url(bad):
        digits = "".join(rng.choice(list("0123456789"), 12)) if bad else ""
        name = "".join(rng.choice(list("abcdefgh"), 6))
        return f"http://{name}{digits}.site.com/" + "/".join(["a"] * int(rng.integers(1, 3 if not bad else 7))) + ("?x=1&y=2&z=3" if bad else "")

    rows = [(i, url(i % 2), "block" if i % 2 else "allow") for i in range(600)]
    df = urls.prepared(spark.createDataFrame([r[:2] for r in rows], "page_id long, url string"), rules=())
    known = spark.createDataFrame([(r[0], r[2] if r[0] < 400 else None) for r in rows], "page_id long, known string")
    df = df.drop("ruled").join(known, "page_id").withColumnRenamed("known", "ruled")
    got = {r.page_id: r.verdict for r in urls.fit(df, rounds=5).judge(df).collect()}
    assert np.mean([got[i] == v for i, _, v in rows[400:]]) > 0.95


def test_url_statistics_cover_all_rows_out_of_fold(spark):
    rows = [(i, f"http://h{i % 40}.{'good' if i % 2 else 'bad'}.com/p{i}", "allow" if i % 2 else "block") for i in range(200)] + [(900, "http://hot.bad.com/", "block")] * 500
    df = urls.prepared(spark.createDataFrame([r[:2] for r in rows], "page_id long, url string"), rules=())
    df = df.drop("ruled").withColumn("ruled", F.when(F.col("domain") == "good.com", "allow").otherwise("block"))
    model = urls.fit(df, max_labelled=50, rounds=2)
    total = {r.domain: (r.b, r.n) for r in model.folds["domain"].groupBy("domain").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).collect()}
    assert total == {"good.com": (0.0, 100.0), "bad.com": (600.0, 600.0)} and model.prior == 600 / 700
    each = spark.createDataFrame([("bad.com", "com", int(k)) for k in range(urls.FOLDS)], "domain string, suffix string, fold long")
    own = {r.fold: (r.b, r.n) for r in model.folds["domain"].where("domain = 'bad.com'").collect()}
    for r in model._out_of_fold(each).collect():
        b, n = own.get(r.fold, (0, 0))
        assert r.f_domain == pytest.approx((600 - b + 5 * model.prior) / (600 - n + 5))


def test_url_model_without_both_labels(spark):
    for rule, want in ((("block", "zzz", "/"), "allow"), (("block", "com", "/"), "block"), (("allow", "com", "/"), "allow")):
        df = urls.prepared(spark.createDataFrame([(1, "http://a.com/"), (2, "http://b.io/")], "page_id long, url string"), rules=(rule,))
        assert {r.page_id: r.verdict for r in urls.fit(df).judge(df).collect()}[2] == want


def test_escape_round_trip():
    for s in ("", "\\", "</s>", "<\\/s>", "\\</s>", "<\\\\/s>", "[INST] a [/INST]</s><s>", "[\\INST]\\\\", "<<s>>", "\\\\</s>\\"):
        assert chat.unescape(chat.escape(s)) == s
        assert not any(c in chat.escape(s) for c in chat.CONTROL)
        turn, _ = chat.format_turn(s, s)
        assert chat.parse_turns(turn * 2) == [(s, s)] * 2


def plain_digests(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn or 0), (role is not None, role or ""), (text is not None, text or "")))
    out = {}
    for conv, turns in by.items():
        turns = [(r[1], t[1]) for _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ODD_TURNS = [(1, 0, "user", "a</s>"), (1, 1, "assistant", None), (1, 2, "assistant", "é\\[INST]"), (2, 0, "user", "only"), (3, 0, "assistant", "first"), (3, 1, "user", "last"),
             (4, 5, "user", "tie"), (4, 5, "assistant", "tie"), (4, 5, "assistant", "tie"), (5, None, None, None), (None, 0, "user", "q"), (None, 1, "assistant", ""),
             (6, 0, "</s>\n", "x" * 200_000), (6, 1, "assistant", "y" * 100_000), (6, 2, "assistant", "z"), (7, 0, "assistant", "")]


def test_chat_query(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_MID}/conversations.parquet").select("conv_id", "turn", "role", "text").where("conv_id > 100").collect()] + ODD_TURNS
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, example int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.q_chat(spark, str(tmp_path)).collect()}
    probe = "</s>[INST] ok [/INST]"
    assert got == plain_digests([*rows, (-7, 0, "user", probe), (-7, 1, "assistant", probe)])


def test_examples_hold_all_turns_before_the_reply(spark):
    turns = [t for t in ODD_TURNS if t[0] is not None]
    out = chat.expand(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    by = defaultdict(list)
    for c, n, r, t in turns:
        by[c].append(((n is not None, n or 0), r or "", t or ""))
    for conv, rows in by.items():
        rows = [(r, t) for _, r, t in sorted(rows)]
        mine = sorted((e for e in out if e.conv_id == conv), key=lambda e: e.example)
        ends = [k + 1 for k, (r, _) in enumerate(rows) if r == "assistant"]
        targets = [*ends, *([len(rows)] if len(rows) not in ends else [])]
        assert [chat.parse_turns(e.text) for e in mine] == [rows[:k] for k in targets]
        for e, k in zip(mine, targets, strict=True):
            masked = chat.unescape(e.text[e.loss_start:e.loss_end])
            assert masked == (rows[k - 1][1] if k in ends else "") and e.last == (k == len(rows)) and e.turns == k


def test_empty(spark, empty_dir):
    assert mtree.q_mtree(spark, empty_dir).count() == 0
    assert sharding.q_sharding(spark, empty_dir).count() == 0
    assert urls.q_urls(spark, empty_dir).count() == 0
    assert [r.conv_id for r in chat.q_chat(spark, empty_dir).collect()] == [-7]
