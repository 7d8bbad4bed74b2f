"""Exact top-k search by inner product in M-trees, best first.

Components become integers floor(256 x), so scores are exact. Vectors are dealt to trees of
about `TREE_ROWS` rows: by their nearest pivot (at most `MAX_PIVOTS`, from a bounded sample
of rows), and within a pivot by a hash, so that any number of equal vectors is spread. Each
tree is a set of written pages. An entry of an inner page holds a routing object, its
Euclidean distance to the page's own routing object, the covering radius of its subtree, and
the subtree's largest norm and least id; a leaf entry is a vector with its parent distance.

From q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2, a lower bound of the distance bounds the score:
|d(q, parent) - d(entry, parent)| - radius without computing anything, then
d(q, entry) - radius, and q.entry + |q| radius. A page waits in a heap under its bound, and a
tree is left when the best bound cannot beat the k-th result. Bounds are rounded to whole
scores, and at equal score the least id decides, so pages of equal vectors are cut too.

Queries meet their own tree first; its k-th score is their threshold in all other trees. Blocks
of queries walk a tree together: a page waits under the best bound of those that want it, and is
compared with all of them at once; each query keeps its own threshold and drops out of a page on its own.

Defined cases: null vectors, vectors with null or non-finite components and rows with a null
vec_id take no part; shorter vectors count as padded with zeros; rows with one vec_id are rows
of their own (ties by vec_id, then row), and only the query's own row is no candidate; with
fewer than k candidates all are returned; an empty table gives no rows. Components of any size
are whole doubles: where products are too large for exact double sums, bounds are widened by the
error of a sum and every possible result is scored in Python integers; ranks follow the exact scores,
and a score beyond 64 bits is null. An entry whose 256-fold is no finite double takes no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewatch.llm.common import as_batch, extended, table, written

TREE_ROWS, MAX_PIVOTS = 4096, 256
LEAF, FANOUT = 128, 16
BLOCK_QUERIES = 256

PAGE = pa.schema([("tree", pa.int32()), ("queries", pa.bool_()), ("page", pa.int32()), ("leaf", pa.bool_()), ("vectors", pa.binary()), ("to_parent", pa.binary()),
                  ("radius", pa.binary()), ("norm", pa.binary()), ("least", pa.binary()), ("ref", pa.binary())])
PAGE_DDL = "tree int, queries boolean, page int, leaf boolean, vectors binary, to_parent binary, radius binary, norm binary, least binary, ref binary"


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Lists as rows of a matrix, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = column.value_lengths().to_numpy().astype(np.int64)
    out = np.zeros((len(column), dim))
    rows = np.repeat(np.arange(len(n)), n)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)] = column.flatten().to_numpy()
    return out


def distances(x: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of x to o; sums of integers are exact."""
    return np.sqrt(((x - o) ** 2).sum(-1))


class Builder:
    """Top-down bulk load of one tree."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.x, self.ids, self.rows = x, ids, rows
        self.norm = (x ** 2).sum(1)
        self.pages: list[tuple] = []

    def page(self, at: np.ndarray, parent: np.ndarray | None) -> int:
        """Make the page of vectors `at` under routing object `parent`; its number."""
        number = len(self.pages)
        self.pages.append(())
        far = lambda o: np.zeros(len(o)) if parent is None else distances(o, parent)
        if len(at) <= LEAF:
            x = self.x[at]
            self.pages[number] = (True, x, far(x), np.zeros(len(at)), self.norm[at], self.ids[at], self.rows[at])
            return number
        # Routing objects: distinct vectors of a seeded sample, so that groups are of like size,
        # and no more of them than fill their pages well.
        fanout = max(2, min(FANOUT, -(-10 * len(at) // (7 * LEAF))))
        some = at[np.random.default_rng([len(at), number]).permutation(len(at))[:4 * FANOUT]]
        chosen = some[np.sort(np.unique(self.x[some], axis=0, return_index=True)[1])][:fanout]
        if len(chosen) == 1:
            d = distances(self.x[at], self.x[chosen[0]])
            chosen = np.append(chosen, at[d.argmax()]) if d.max() > 0 else chosen
        if len(chosen) == 1:  # all equal: runs of ids
            order = np.lexsort((self.rows[at], self.ids[at]))
            groups = np.array_split(at[order], min(FANOUT, -(-len(at) // LEAF)))
            chosen = np.array([g[0] for g in groups])
        else:
            x = self.x[chosen]
            owner = ((x ** 2).sum(1) - 2 * self.x[at] @ x.T).argmin(1)
            groups = [at[owner == k] for k in range(len(chosen))]
        o = self.x[chosen]
        child = [self.page(g, c) for g, c in zip(groups, o, strict=True)]
        radius = np.array([distances(self.x[g], c).max() for g, c in zip(groups, o, strict=True)])
        norm, least = np.array([self.norm[g].max() for g in groups]), np.array([self.ids[g].min() for g in groups])
        self.pages[number] = (False, o, far(o), radius, norm, least, np.array(child, np.int64))
        return number


def _build(dim: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        b = Builder(matrix(t["v"], dim), t["vec_id"].to_numpy(), t["rid"].to_numpy())
        b.page(np.lexsort((b.rows, b.ids)), None)
        cols = list(zip(*b.pages, strict=True))
        raw = [[np.ascontiguousarray(v, kind).tobytes() for v in c] for c, kind in zip(cols[1:], ("<f8", "<f8", "<f8", "<f8", "<i8", "<i8"), strict=True)]
        n = len(b.pages)
        return pa.Table.from_batches([as_batch(PAGE, [np.full(n, key[0].as_py(), np.int32), [False] * n, np.arange(n, dtype=np.int32), list(cols[0]), *raw])])

    return run


class Tree:
    """Pages by number, as arrays."""

    def __init__(self, dim: int):
        self.dim, self.pages = dim, {}

    def add(self, number: int, leaf: bool, vectors: bytes, to_parent: bytes, radius: bytes, norm: bytes, least: bytes, ref: bytes) -> None:
        f = lambda b: np.frombuffer(b, "<f8")
        self.pages[number] = (leaf, f(vectors).reshape(-1, self.dim), f(to_parent), f(radius), f(norm), np.frombuffer(least, "<i8"), np.frombuffer(ref, "<i8"))

    def search(self, x: np.ndarray, own: np.ndarray, k: int, floors: list[tuple[int, int, int] | None], wide: bool = False) -> list[list[tuple[int, int, int]]]:
        """For each query (a row of `x`) the (score, -id, -row) of up to k best rows but row `own`, if
        above its floor, ascending. `wide`: scores need more than doubles."""
        found = _Results(k, floors)
        q2 = (x ** 2).sum(1)
        everyone = np.arange(len(x))
        heap: list[tuple] = [(-np.inf, 0, 0, everyone, np.full(len(x), np.inf), None)]
        while heap:
            top, low, number, who, most, d_parent = heapq.heappop(heap)
            if -top < found.score.min():
                break  # no page left can do better for any query
            stay = found.hopeful(who, most, low)
            who, d_parent = who[stay], None if d_parent is None else d_parent[stay]
            if not len(who):
                continue
            leaf, o, to_parent, radius, norm, least, ref = self.pages[number]
            todo = np.arange(len(o))
            if d_parent is not None:  # the stored distances spare computations
                near = np.abs(d_parent[:, None] - to_parent) - radius - 1e-9 * (d_parent[:, None] + to_parent)
                hope = found.hopeful(who[:, None], _bound(q2[who], near, norm), least)
                todo = np.flatnonzero(hope.any(axis=0))
                rows = hope.any(axis=1)
                who = who[rows]
            if not len(todo):
                continue
            score = x[who] @ o[todo].T
            if leaf:
                error = 1e-14 * len(x.T) * np.sqrt(q2[who, None] * norm[todo]) if wide else 0.0
                for a, i in np.argwhere(found.hopeful(who[:, None], score + error, least[todo])).tolist():
                    q, row = who[a], todo[i]
                    if ref[row] != own[q]:
                        exact = sum(int(u) * int(v) for u, v in zip(x[q].tolist(), o[row].tolist(), strict=True)) if wide else int(score[a, i])
                        found.add(q, (exact, -int(least[row]), -int(ref[row])))
                continue
            if wide:
                d = np.sqrt(((x[who, None, :] - o[None, todo]) ** 2).sum(-1))
            else:
                d = np.sqrt(np.maximum(q2[who, None] + (o[todo] ** 2).sum(1) - 2 * score, 0))
            r = radius[todo]
            most = np.minimum(_bound(q2[who], d - r - 1e-9 * (d + r), norm[todo]), np.floor(score + np.sqrt(q2[who, None]) * r * (1 + 1e-12) + 1e-6 + 1e-12 * np.sqrt(q2[who, None] * norm[todo])))
            hope = found.hopeful(who[:, None], most, least[todo])
            for i in np.flatnonzero(hope.any(axis=0)).tolist():
                some = hope[:, i]
                heapq.heappush(heap, (-float(most[some, i].max()), int(least[todo[i]]), int(ref[todo[i]]), who[some], most[some, i], d[some, i]))
        return [sorted(b) for b in found.best]


class _Results:
    """The k best of each query of a block, and what beats them: a score, and at equal score an id."""

    def __init__(self, k: int, floors: list[tuple[int, int, int] | None]):
        self.k, self.bars = k, list(floors)
        self.best: list[list] = [[] for _ in floors]
        self.score, self.low = np.full(len(floors), -np.inf), np.zeros(len(floors), np.int64)
        for q, bar in enumerate(floors):
            if bar is not None:
                self._raise(q, bar)

    def _raise(self, q: int, bar: tuple[int, int, int]) -> None:
        # A double below the exact score: pages at the bar itself are not cut too early.
        near = float(bar[0])
        self.bars[q], self.score[q], self.low[q] = bar, near if near <= bar[0] else np.nextafter(near, -np.inf), -bar[1]

    def hopeful(self, who: np.ndarray, most: np.ndarray, least) -> np.ndarray:
        """Where `most` may still beat the bar of `who`."""
        score = self.score[who]
        return ~(most < score) & ((most != score) | (least <= self.low[who]) | np.isinf(score))

    def add(self, q: int, row: tuple[int, int, int]) -> None:
        bar, best = self.bars[q], self.best[q]
        if bar is not None and row <= bar:
            return
        if len(best) < self.k:
            heapq.heappush(best, row)
        else:
            heapq.heapreplace(best, row)
        if len(best) == self.k and (bar is None or best[0] > bar):
            self._raise(q, best[0])


def _bound(q2: np.ndarray, dist: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Largest whole scores at distances of at least `dist`."""
    both = q2[:, None] + norm
    return np.floor((both - np.maximum(dist, 0) ** 2) / 2 + 1e-6 + 1e-12 * both)


def sort_key(score: int) -> str:
    """Text that sorts like the number."""
    digits = str(abs(score))
    text = f"{len(digits):05d}{digits}"
    return "1" + text if score >= 0 else "0" + text.translate(_NINES)


_NINES = str.maketrans("0123456789", "9876543210")


def _search(dim: int, k: int, wide: bool):
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("score", pa.string()), ("key", pa.string()), ("vec_id", pa.int64()), ("rid", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, tree = None, Tree(dim)
        for b in batches:
            out = []
            for at in range(b.num_rows):
                t, queries, page, leaf, *raw = (c[at].as_py() for c in b.columns)
                if t != number:  # pages of a tree come before its queries
                    number, tree = t, Tree(dim)
                if not queries:
                    tree.add(page, leaf, *raw)
                    continue
                if not tree.pages:
                    continue
                x = np.frombuffer(raw[0], "<f8").reshape(-1, dim)
                marks = np.frombuffer(raw[1], "<i8").reshape(-1, 3).tolist()
                scores = raw[2].decode().split(",")
                ids, rows = np.frombuffer(raw[4], "<i8"), np.frombuffer(raw[5], "<i8")
                floors = [(int(f), i, r) if known else None for f, (known, i, r) in zip(scores, marks, strict=True)]
                with np.errstate(over="ignore", invalid="ignore"):
                    found = tree.search(x, rows, k, floors, wide)
                out += [(r, i, str(f), sort_key(f), -m, -w) for r, i, best in zip(rows.tolist(), ids.tolist(), found, strict=True) for f, m, w in best]
            if out:
                yield as_batch(schema, [list(c) for c in zip(*out, strict=True)])

    return run


def _block(dim: int):
    """One row from a block of queries, addressed to tree `tree`. A floor is (known, -id, -row) and a score."""
    def run(key: tuple, t: pa.Table) -> pa.Table:
        x = matrix(t["v"], dim)
        marks = np.stack([t[c].to_numpy() for c in ("known", "f_id", "f_row")], 1)
        scores = ",".join(t["f_score"].to_pylist()).encode()
        raw = [x.astype("<f8").tobytes(), marks.astype("<i8").tobytes(), scores, b"", t["vec_id"].to_numpy().astype("<i8").tobytes(), t["rid"].to_numpy().astype("<i8").tobytes()]
        return pa.Table.from_batches([as_batch(PAGE, [[key[0].as_py()], [True], [key[1].as_py()], [False], *[[r] for r in raw]])])

    return run


def integers(vectors: DataFrame, column: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): components as whole doubles, of the rows that take part."""
    v = F.transform(column, lambda x: x.cast("double") * scale)
    ok = F.col("vec_id").isNotNull() & F.col(column).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    floor = lambda x: F.rint(x) - F.when(F.rint(x) > x, F.lit(1.0)).otherwise(F.lit(0.0))
    return vectors.where(ok).select("vec_id", F.transform(v, floor).alias("v"))


class Forest:
    """Written M-trees over all rows of (vec_id, v)."""

    def __init__(self, vectors: DataFrame, query: Column, tree_rows: int = TREE_ROWS, max_pivots: int = MAX_PIVOTS):
        rows = written(vectors.select("vec_id", "v", F.coalesce(query, F.lit(False)).alias("query")).withColumn("rid", F.monotonically_increasing_id()), "vectors")
        most = F.max(F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0)))
        facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), most.alias("most")).first()
        self.dim = max(1, facts["dim"] or 1)
        self.wide = 4 * self.dim * float(facts["most"] or 0) ** 2 >= 1 << 53
        # Pivots: the first distinct vectors of a bounded sample, rows in the order of a hash.
        n = max(1, min(max_pivots, (facts["n"] or 0) // tree_rows))
        sample = rows.select("v", F.xxhash64("rid").alias("h")).orderBy("h").limit(4 * max_pivots).collect()
        pivots = list(dict.fromkeys(tuple(r["v"]) for r in sample))[:n]
        if pivots:
            p = np.zeros((len(pivots), self.dim))
            for i, v in enumerate(pivots):
                p[i, :len(v)] = v
            rows = written(rows.mapInArrow(_nearest(p), extended(rows.schema, "pivot int")), "pivoted")
        else:
            rows = rows.withColumn("pivot", F.lit(0))
        trees, base = F.lit(0), 0
        for r in rows.groupBy("pivot").count().orderBy("pivot").collect():  # at most max_pivots rows
            parts = -(-r["count"] // tree_rows)
            trees = F.when(F.col("pivot") == r["pivot"], base + F.pmod(F.xxhash64("rid"), F.lit(parts))).otherwise(trees)
            base += parts
        self.n_trees = base
        self.rows = rows.withColumn("tree", trees.cast("int"))
        spark = vectors.sparkSession
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.pages = written(self.rows.select("tree", "vec_id", "v", "rid").groupBy("tree").applyInArrow(_build(self.dim), PAGE_DDL), "pages")

    def _meet(self, blocks: DataFrame, k: int) -> DataFrame:
        both = self.pages.unionByName(blocks).repartition(self.parts, "tree").sortWithinPartitions("tree", "queries", "page")
        return both.mapInArrow(_search(self.dim, k, self.wide), "query_row long, query_id long, score string, key string, vec_id long, rid long")

    def search(self, k: int) -> DataFrame:
        """(query_id, rank, vec_id, score) of every query row."""
        none = [F.lit(0).cast("long").alias("known"), F.lit("0").alias("f_score"), *[F.lit(0).cast("long").alias(c) for c in ("f_id", "f_row")]]
        queries = self.rows.where("query").select("tree", "vec_id", "v", "rid")
        share = F.pmod(F.xxhash64("rid"), F.lit(max(1, -(-queries.count() // BLOCK_QUERIES)))).cast("int")
        at_home = queries.select("*", share.alias("part"), *none).groupBy("tree", "part").applyInArrow(_block(self.dim), PAGE_DDL)
        first = written(self._meet(at_home, k), "home-results")
        rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("key"), "vec_id", "rid"))
        kth = (first.withColumn("rank", rank).where(F.col("rank") == k)
               .select(F.col("query_row").alias("rid"), F.lit(1).cast("long").alias("known"), F.col("score").alias("f_score"), (-F.col("vec_id")).alias("f_id"), (-F.col("rid")).alias("f_row")))
        floors = queries.join(kth, "rid", "left").select("rid", "vec_id", "v", F.col("tree").alias("home"), F.coalesce("f_score", F.lit("0")).alias("f_score"),
                                                         *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("known", "f_id", "f_row")])
        # Every block of queries that share a home visits all other trees.
        blocks = floors.withColumnRenamed("home", "tree").withColumn("part", share).groupBy("tree", "part").applyInArrow(_block(self.dim), PAGE_DDL)
        others = F.filter(F.sequence(F.lit(0), F.lit(max(0, self.n_trees - 1))), lambda t: t != F.col("tree"))
        sent = blocks.withColumn("tree", F.explode(others))
        found = first.unionByName(self._meet(sent, k))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.expr("try_cast(score AS long)").alias("score"))


def _nearest(p: np.ndarray):
    half = (p ** 2).sum(1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), p.shape[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((x @ p.T - half).argmax(1).astype(np.int32))], names=[*b.schema.names, "pivot"])

    return run


def q_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Forest(integers(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0).search(5)


QUERIES = {"op1_mtree_topk": q_mtree}
ORACLE = {"op1_mtree_topk": """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS score
  FROM x q JOIN x c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5"""}
