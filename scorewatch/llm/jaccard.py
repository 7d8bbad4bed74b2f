"""N-gram Jaccard join: exact links between word-shingle sets by T-occurrence search.

1. One pass over all texts gives each document's set size and 128-bit set fingerprint.
   Documents with equal fingerprints are one set from here on.
2. Two sets that link miss at most d = n - ceil(0.8 n) of the shingles of each. So of any fixed part
   of the shingle universe that holds more than d shingles of a set, some are common; and in one
   order of all shingles, the first common one is among the first d + 1 of both. The part is
   the shingles below a threshold (`SAMPLES`; the least that leaves each set enough, or all of them);
   sets below 1.25 * `SMALL` use all of theirs, in an index of their own. The order is by the number of
   documents, counted exactly: the shingles of a slice of texts go, packed and once a set, to the
   shingle's partition, and only those found elsewhere too come back to the slice. A set whose
   d + 1 rarest shingles are its alone links with nothing and is out.
3. The shingles left among the first d + 1, seldom those of passages that many documents share,
   tie sets into blocks (connected components); no set links outside its block.
4. Each block's texts meet once. Sets are searched by growing size among smaller ones by
   DivideSkip: the longest lists are set aside, the short ones are merged, and what they
   leave is binary-probed in the long lists until the required overlap is out of reach.
   Blocks above `BLOCK_SHINGLES` are dealt into chunks, and every pair of chunks meets.
5. Links (a spanning forest per task) give the components.

Shingles are 64-bit hashes of `N` words. A document of fewer words has its whole sequence
as one shingle; one without words (or null text) has none and links with nothing.
A null doc_id is a document of its own set; component ids are the least non-null id.
Repeated ids and rows are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm.common import as_batch, bundled, given_back, slices, table, unbundled, written
from scorewatch.llm.components import components
from scorewatch.llm.filters import filter_of, passed
from scorewatch.llm.encoders import ragged
from scorewatch.llm.words import mix, positions, split_words, window_hashes, word_hashes

N = 5
#: Shares of the shingle universe that sets of `SMALL` shingles or more may send.
SAMPLES, SMALL = (0.4, 0.55, 0.7, 0.85, 1.0), 256
#: Bits of a shingle that travel; equal ones of different shingles cost work, no result.
KEY_BITS = 48
#: From so many sets of one slice on, a shingle leaves the slice once for all of them.
LOCAL_HOT, HOT_OWNER = 16, 0xFFFF
BLOCK_SHINGLES = 1 << 20
#: Bits of the filter of texts that meet others; it saves shuffling the rest, beyond about as many
#: texts as bits less and less.
TEXT_BITS = 1 << 25


def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, row) of all texts, repeated shingles included, rows in order."""
    counts, codes, dictionary = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    h = word_hashes(dictionary)[codes]
    shingle, owner = window_hashes(h, counts, N)
    few = np.flatnonzero((counts > 0) & (counts < N))
    if len(few):
        begin = np.cumsum(counts) - counts
        short = np.zeros(len(few), np.uint64)
        for k in range(N - 1):
            has = counts[few] > k
            short[has] = mix(short[has] * np.uint64(0x9E3779B97F4A7C15) + h[begin[few[has]] + k])
        shingle, owner = np.concatenate([shingle, mix(short + counts[few].astype(np.uint64))]), np.concatenate([owner, few])
        order = np.argsort(owner, kind="stable")
        shingle, owner = shingle[order], owner[order]
    return shingle, owner


def ordered(shingle: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (shingle, row), by row and shingle."""
    at = np.lexsort((shingle, owner))
    shingle, owner = shingle[at], owner[at]
    new = np.ones(len(at), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    return shingle[new], owner[new]


def misses(n: np.ndarray) -> np.ndarray:
    """Most shingles of a set of n that a linked one may lack."""
    return n - (4 * n + 4) // 5


def keys_of(shingle: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, row) of distinct shingles in order: their upper KEY_BITS."""
    key = shingle >> np.uint64(64 - KEY_BITS)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[new], owner[new]


def threshold(share: float) -> np.uint64:
    return np.uint64(min(int(share * (1 << KEY_BITS)), (1 << KEY_BITS) - 1))


def fingerprints(shingle: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set size, two 64-bit sums over the set) of each row, from distinct shingles in row order."""
    n = np.bincount(owner, minlength=rows).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    out = []
    for salt in (0x51ED270B, 0x2545F491):
        run = np.concatenate([[np.uint64(0)], np.cumsum(mix(shingle + np.uint64(salt)), dtype=np.uint64)])
        out.append((run[ends[1:]] - run[ends[:-1]]).view(np.int64))
    return n, out[0], out[1]


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tkey, n, f1, f2, sample): `sample` numbers the least share of the universe that leaves
    more shingles of the set than a linked one may lack."""
    schema = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sample", pa.int32())])
    for b in slices(batches, "text"):
        shingle, owner = ordered(*sets(b.column("text")))
        n, f1, f2 = fingerprints(shingle, owner, b.num_rows)
        key, of = keys_of(shingle, owner)
        few = [np.bincount(of[key <= threshold(x)], minlength=b.num_rows) <= misses(n) for x in SAMPLES[:-1]]
        sample = np.where(n >= SMALL, np.sum(few, axis=0), 0).astype(np.int32)
        yield as_batch(schema, [b.column("doc_id"), b.column("tkey"), n, f1, f2, sample])


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit integers as one string of bytes."""
    return np.concatenate([np.array([len(arrays), *map(len, arrays)], np.int64), *(x.astype(np.int64) for x in arrays)]).tobytes()


def unpacked(raw: bytes) -> list[np.ndarray]:
    all_ = np.frombuffer(raw, np.int64)
    k = int(all_[0])
    return np.split(all_[1 + k:], np.cumsum(all_[1:1 + k])[:-1])


def key_bytes(key: np.ndarray) -> bytes:
    """Keys by byte planes: the upper bytes of sorted keys repeat."""
    return np.ascontiguousarray(key.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEY_BITS // 8:].T).tobytes()


def keys_from(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(KEY_BITS // 8, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 8 - KEY_BITS // 8:] = planes.T
    return out.view(">u8").ravel().astype(np.uint64)


SENT = "part int, base long, keys binary, owners binary, weights binary, facts binary"
SENT_SCHEMA = pa.schema([("part", pa.int32()), ("base", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()), ("weights", pa.binary()), ("facts", pa.binary())])


def _send(share: float, parts: int):
    """Rows for the partitions of shingles: of every slice `base` its (key, owner) pairs, owners
    numbering its different sets, small sets' in partitions of their own; and one row of facts for the
    slice itself: fingerprints, sizes, keys in both indices, and who owns the keys sent once for many."""
    most = threshold(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for b in slices(batches, "text"):
            base, number = (task << 32) + number, number + 1
            shingle, owner = ordered(*sets(b.column("text")))
            n, f1, f2 = fingerprints(shingle, owner, b.num_rows)
            # Equal sets of a slice count once.
            some = np.flatnonzero(n > 0)
            first = some[np.sort(np.unique(np.stack([f1[some], f2[some]], 1), axis=0, return_index=True)[1])] if len(some) else some
            if not len(first):
                continue
            place = np.full(b.num_rows, -1)
            place[first] = np.arange(len(first))
            key, of = keys_of(shingle, owner)
            of = place[of]
            key, of = key[of >= 0], of[of >= 0]
            n = n[first]
            rows, sizes, hot = [], [], []
            for small, use in ((1, n[of] < SMALL + SMALL // 4), (0, (n[of] >= SMALL) & (key <= most))):
                k, o = key[use], of[use]
                sizes.append(np.bincount(o, minlength=len(first)))
                order = np.lexsort((o, k))
                k, o = k[order], o[order]
                begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
                count = np.diff(np.append(begin, len(k)))
                many = np.repeat(count >= LOCAL_HOT, count)
                shared = count >= LOCAL_HOT
                hot += [k[begin[shared]], count[shared], o[many]]
                k, o = np.concatenate([k[~many], k[begin[shared]]]), np.concatenate([o[~many], np.full(int(shared.sum()), HOT_OWNER)])
                w = np.concatenate([np.ones(int((~many).sum()), np.int64), count[shared]])
                part = (k % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((k, part))
                k, o, w, part = k[order], o[order], w[order], part[order]
                ends = np.searchsorted(part, np.arange(parts + 1))
                for i, (x, z) in enumerate(itertools.pairwise(ends.tolist())):
                    if z > x:
                        rows.append((2 * i + small, base, key_bytes(k[x:z]), o[x:z].astype("<u2").tobytes(), w[x:z][o[x:z] == HOT_OWNER].astype("<u4").tobytes(), None))
            rows.append((base % (2 * parts), base, b"", b"", b"", packed(f1[first], n, *sizes, *hot)))
            yield as_batch(SENT_SCHEMA, list(map(list, zip(*rows, strict=True))))

    return run


BACK = "base long, small int, keys binary, owners binary, levels binary, facts binary"
BACK_SCHEMA = pa.schema([("base", pa.int64()), ("small", pa.int32()), ("keys", pa.binary()), ("owners", pa.binary()), ("levels", pa.binary()), ("facts", pa.binary())])


def _shared(group: tuple, t: pa.Table) -> pa.Table:
    """The keys of a partition that more than one set has, back to their slices with their level: eight for
    each doubling of the number of sets. Facts pass through."""
    t = t.combine_chunks()
    out = []
    rows = list(zip(*(t[c].to_pylist() for c in ("base", "keys", "owners", "weights", "facts")), strict=True))
    rows, through = [r for r in rows if r[4] is None], [r for r in rows if r[4] is not None]
    out += [(base, 0, b"", b"", b"", facts) for base, *_, facts in through]
    if rows:
        keys = [keys_from(r[1]) for r in rows]
        owners = [np.frombuffer(r[2], "<u2") for r in rows]
        weights = [np.ones(len(o), np.int64) for o in owners]
        for w, o, r in zip(weights, owners, rows, strict=True):
            w[o == HOT_OWNER] = np.frombuffer(r[3], "<u4")
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        df = np.bincount(which, weights=np.concatenate(weights))
        level = np.minimum(np.round(8 * np.log2(df)), 255).astype(np.uint8)[which]
        more = (df > 1.5)[which]
        small = group[0].as_py() % 2
        at = 0
        for r, k, o in zip(rows, keys, owners, strict=True):
            keep, own = more[at:at + len(k)], level[at:at + len(k)]
            at += len(k)
            if keep.any():
                out.append((r[0], small, key_bytes(k[keep]), o[keep].tobytes(), own[keep].tobytes(), None))
    return pa.Table.from_batches([as_batch(BACK_SCHEMA, list(map(list, zip(*out, strict=True))) if out else [[]] * 6)])


def _first_shared(group: tuple, t: pa.Table) -> pa.Table:
    """Rows (key, a, null): set a has the shared shingle `key` among its first; (key, a, b): a shares one
    with b. Within a slice each key names one set, and the others are tied to it."""
    rows = list(zip(*(t[c].to_pylist() for c in ("small", "keys", "owners", "levels", "facts")), strict=True))
    f1, n, all_small, all_large, *hot = unpacked(next(r[4] for r in rows if r[4] is not None))
    keys, nodes = [], []
    for small, size, (hot_key, hot_n, hot_owner) in ((1, all_small, hot[:3]), (0, all_large, hot[3:])):
        mine = [r for r in rows if r[4] is None and r[0] == small]
        if not mine:
            continue
        key = np.concatenate([keys_from(r[1]) for r in mine])
        owner = np.concatenate([np.frombuffer(r[2], "<u2") for r in mine]).astype(np.int64)
        level = np.concatenate([np.frombuffer(r[3], np.uint8) for r in mine])
        many = owner == HOT_OWNER  # such a key goes to all that have it, in the order of the facts
        where = np.argsort(key[many])
        k, lv = key[many][where], level[many][where]
        assert (k == hot_key.astype(np.uint64)).all()  # noqa: S101 - sent once, shared for certain
        key = np.concatenate([key[~many], np.repeat(k, hot_n)])
        level = np.concatenate([level[~many], np.repeat(lv, hot_n)])
        owner = np.concatenate([owner[~many], hot_owner])
        alone = size - np.bincount(owner, minlength=len(n))
        quota = misses(n) + 1 - alone
        order = np.lexsort((key, level, owner))
        key, owner = key[order], owner[order]
        use = positions(np.bincount(owner, minlength=len(n)))[1] < quota[owner]
        keys.append(key[use].astype(np.int64) | small << KEY_BITS)
        nodes.append(f1[owner[use]])
    key, node = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, nodes))
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    head = node[first][np.cumsum(first) - 1] if len(key) else node
    tie = np.unique(np.stack([node[head != node], head[head != node]], 1), axis=0) if (head != node).any() else np.zeros((0, 2), np.int64)
    return pa.table({"key": pa.array(np.concatenate([key[first], tie[:, 0]])), "a": pa.array(np.concatenate([node[first], tie[:, 0]])),
                     "b": pa.concat_arrays([pa.nulls(int(first.sum()), pa.int64()), pa.array(tie[:, 1])])})


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from rows sorted by key: each set of a key is tied to the key's first."""
    last_key, last_head = None, None
    for b in batches:
        key, a, tie = (b.column(c) for c in ("key", "a", "b"))
        direct = tie.is_valid().to_numpy(zero_copy_only=False)
        out = [np.stack([a.to_numpy()[direct], tie.filter(pa.array(direct)).to_numpy()], 1)]
        k, node = key.to_numpy()[~direct], a.to_numpy()[~direct]
        if len(k):
            first = np.ones(len(k), bool)
            first[1:] = k[1:] != k[:-1]
            head = node[first][np.cumsum(first) - 1]
            if last_key == k[0]:
                head = np.where(k == k[0], last_head, head)
            out.append(np.stack([node, head], 1)[node != head])
            last_key, last_head = k[-1], head[-1]
        pairs = np.unique(np.concatenate(out), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def merged(met: np.ndarray, lo: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The different sets from `lo` in the concatenated lists, and how often each is there. Few
    entries are sorted; counters for all sets of lo..q serve only where there are more entries."""
    met = met[met >= lo]
    if len(met) < q - lo:
        return np.unique(met, return_counts=True)
    count = np.bincount(met - lo)
    r = np.flatnonzero(count)
    return r + lo, count[r]


class Search:
    """DivideSkip over sets in order of growing size; set q is searched among those before it.

    `code` holds the list numbers of all sets one after another (`begin` of each), lists being
    numbered by growing length, so that a set's shortest lists come first. A list is the
    ascending places of the sets that hold its shingle."""

    def __init__(self, sizes: np.ndarray, begin: np.ndarray, code: np.ndarray, lists: int):
        self.sizes, self.begin, self.code = sizes, begin, code
        owner = np.repeat(np.arange(len(sizes)), np.diff(begin))
        order = np.lexsort((owner, code))
        self.rows = owner[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=lists))])
        self.rank = np.empty(len(code), np.int64)  # of a set in each of its lists
        self.rank[order] = np.arange(len(code)) - self.start[code[order]]
        self.label = np.arange(len(sizes))

    def enter(self, q: int) -> list[int]:
        """Join set q; sets that it links to, one for each component it now joins."""
        at = slice(self.begin[q], self.begin[q + 1])
        own, size = self.code[at], int(self.sizes[q])
        need = (4 * size + 4) // 5
        first, stop = self.start[own], self.start[own] + self.rank[at]
        if len(own) < need:
            return []
        lo = int(np.searchsorted(self.sizes, need))  # smaller sets cannot link
        lists = [self.rows[a:b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
        longest = max(map(len, lists), default=0)
        n_long = min(need - 1, int(need / (0.01 * longest.bit_length() + 1)))
        r, count = merged(np.concatenate(lists[:len(lists) - n_long]), lo, q)
        # One set of each component first: the rest of a component that links need no probe.
        group, most = self.label[r], np.argsort(-count, kind="stable")
        chosen = most[np.unique(group[most], return_index=True)[1]]
        found = self._reached(r[chosen], count[chosen], size, lists[len(lists) - n_long:])
        rest = ~np.isin(group, self.label[found])
        rest[chosen] = False
        more = self._reached(r[rest], count[rest], size, lists[len(lists) - n_long:])
        found = np.concatenate([found, more[np.unique(self.label[more], return_index=True)[1]]])
        for x in found.tolist():
            self.label[self.label == self.label[x]] = q
        return found.tolist()

    def _reached(self, r: np.ndarray, count: np.ndarray, size: int, long: list[np.ndarray]) -> np.ndarray:
        """Sets of r, found `count` times so far, that reach the overlap with the long lists."""
        wanted = -(-4 * (size + self.sizes[r]) // 9)  # 100 * both >= 80 * either
        left = len(long)
        for rows in long:
            hope = count + left >= wanted
            if not hope.all():
                r, count, wanted = r[hope], count[hope], wanted[hope]
            if not len(r):
                break
            if len(rows):
                place = np.minimum(np.searchsorted(rows, r), len(rows) - 1)
                count = count + (rows[place] == r)
            left -= 1
        return r[count >= wanted]


def _search(key: tuple, t: pa.Table) -> pa.Table:
    """Links of a spanning forest between the sets whose texts meet here."""
    text = t["text"].combine_chunks()
    shingle, owner = ordered(*sets(text))
    n, f1, f2 = fingerprints(shingle, owner, t.num_rows)
    # The row of a set may be repeated: take one of each wanted set.
    good = (n > 0) & (f1 == t["f1"].to_numpy()) & (f2 == t["f2"].to_numpy())
    sid, seen, rows = t["sid"].to_numpy(), set(), []
    for i in np.lexsort((sid, n)).tolist():
        if good[i] and sid[i] not in seen:
            seen.add(sid[i])
            rows.append(i)
    # Lists of the wanted sets, numbered by length; shingles of one set alone are no list.
    begin = np.concatenate([[0], np.cumsum(n)])
    at = ragged(begin[rows], n[rows]) if rows else np.zeros(0, np.int64)
    _, code, counts = np.unique(shingle[at], return_inverse=True, return_counts=True)
    by_length = np.argsort(counts, kind="stable")
    number = np.empty(len(counts), np.int64)
    number[by_length] = np.arange(len(counts))
    owner = np.repeat(np.arange(len(rows)), n[rows]) if rows else at
    shared = counts[code] > 1
    code, owner = number[code[shared]], owner[shared]
    order = np.lexsort((code, owner))
    code, ends = code[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(rows)))])
    search = Search(n[rows], ends, code, len(counts))
    u, v = [], []
    del shingle, at, counts, code, owner, order, shared
    for q, i in enumerate(rows):
        for r in search.enter(q):
            u.append(int(sid[i]))
            v.append(int(sid[rows[r]]))
    del search
    given_back()
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def fetched(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(meet, sid, f1, f2, text): each wanted set meets the text of its own row (doc_id, tkey), not
    all texts under a repeated or null doc_id."""
    wanted = wanted.select("meet", "sid", "f1", "f2", F.col("row.doc_id").alias("rep"), F.col("row.tkey").alias("rep_tkey"))
    some = docs.mapInArrow(_let_through(filter_of(wanted.select("rep_tkey"), TEXT_BITS)), docs.schema)
    here = (F.col("rep_tkey") == F.col("tkey")) & F.col("rep").eqNullSafe(F.col("doc_id"))
    return wanted.join(some.hint("merge"), here).select("meet", "sid", "f1", "f2", "text")


def _let_through(bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(passed(b.column("tkey").fill_null(0).to_numpy(), bits)))

    return run


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, n, component, component_id) for every row of `docs` (doc_id, text); `tkey` is
    a hash of the text, `component` numbers the components (null without words)."""
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("tkey"))
    rows = written(docs.mapInArrow(_profile, "doc_id long, tkey long, n long, f1 long, f2 long, sample int"), "shingle-profile")
    share = SAMPLES[rows.agg(F.max("sample")).first()[0] or 0]
    reps = written(rows.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "tkey")).alias("row"), F.max("n").alias("n"))
                   .withColumn("sid", F.monotonically_increasing_id()), "sets")

    back = docs.select("text").mapInArrow(_send(share, n_parts), SENT).groupBy("part").applyInArrow(_shared, BACK)
    shared = (back.groupBy("base").applyInArrow(_first_shared, "key long, a long, b long")
              .repartition(n_parts, "key").sortWithinPartitions("key", "a").mapInArrow(_ties, "u long, v long"))
    blocks = written(components(shared).join(reps, F.col("node") == F.col("f1")).select("sid", "row", "f1", "f2", "n", F.col("component").alias("block")), "blocks")
    sums = blocks.groupBy("block").agg(F.sum("n").alias("size"))
    total = sums.agg(F.sum("size").alias("s")).first()["s"] or 0
    groups = 1 + 2 * total // BLOCK_SHINGLES  # about half a limit together, and one block more at most
    # A block above the limit is dealt into chunks; every pair of chunks is a group of its own.
    chunks = F.greatest(F.lit(1), F.ceil(2 * F.col("size") / BLOCK_SHINGLES))
    dealt = (blocks.join(sums.where(F.col("size") > BLOCK_SHINGLES).select("block", chunks.alias("chunks")), "block", "left")
             .withColumn("chunk", F.when(F.col("chunks").isNotNull(), F.pmod(F.xxhash64("sid"), "chunks")).cast("int"))
             .withColumn("other", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int")))))
             .withColumn("meet", F.when(F.col("chunks").isNull(), F.pmod(F.xxhash64("block"), F.lit(groups)))
                         .otherwise(F.xxhash64("block", F.least("chunk", "other"), F.greatest("chunk", "other")))))
    met = fetched(dealt.select("meet", "sid", "row", "f1", "f2"), docs)
    links = met.groupBy("meet").applyInArrow(lambda key, t: _search(key, t), "u long, v long")
    found = components(links)
    named = reps.select("sid", "f1", "f2", "rep").join(found.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("f1", "f2", "component", "component_id")
    out = rows.where("n > 0").join(named, ["f1", "f2"]).select("doc_id", "tkey", "n", "component", "component_id")
    return out.unionByName(rows.where("n = 0").select("doc_id", "tkey", "n", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without all but one document of each component; documents without
    words stay. The least (doc_id, text hash) of a component is kept. Components that share a
    component id, as those without or with repeated doc_ids do, keep one each."""
    kept = classes(docs).where("n > 0").groupBy("component").agg(F.min(F.struct("doc_id", "tkey")).alias("k"))
    # One key of both, never null: the texts move once for the join and for repeated rows.
    key = lambda i, t: F.concat_ws(" ", F.coalesce(i.cast("string"), F.lit("-")), t.cast("string"))
    kept = kept.select(key(F.col("k.doc_id"), F.col("k.tkey")).alias("key"))
    rows = bundled(docs).withColumn("key", key(F.col("row.doc_id"), F.xxhash64("text")))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^ \t-\r]")
    chosen = rows.where(worded).join(kept.hint("merge"), "key", "left_semi").dropDuplicates(["key"])
    return unbundled(chosen.unionByName(rows.where(~worded)), docs.columns)


def q_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


QUERIES = {"op5_jaccard_join": q_jaccard}
ORACLE: dict[str, str] = {}
