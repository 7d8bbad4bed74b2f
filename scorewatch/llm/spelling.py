"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Two words of the lengths l <= L are one edit apart exactly if they differ and their common
prefix and common suffix together reach L - 1. So one of the two reaches half of L - 1, rounded
up: words meet under that prefix, and under that suffix, once for L = their length and once for
a partner one longer. Where they meet, they lie sorted by group in padded matrices of code
points, left- and right-aligned; blocks of `BLOCK` rows are compared with each other whole, position
by position, and all pairs of two blocks keep their prefix and suffix lengths at once. A pair
that meets under its prefix is not reported under its suffix again.

A group above `TILE` words is dealt into tiles, and every two tiles are a group of their own, so no
task holds more than two tiles of a group. Only pairs one edit apart leave a task; per word they
are added up before the shuffle.

A variant's form is its near word of largest count (ties: the smallest by code points) if that
count is `RATIO` times its own or more. Counts grow by that factor along a chain of forms, so
chains are short, and doubling steps lead every word to the end of its chain.

Defined cases: a null text has no words; a null doc_id counts as an empty string in the
damage of runs; repeated rows count as often as they stand there; an empty table gives no
rows; other columns are not used. Words of any length are compared whole: blocks of long words
hold fewer rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm.common import as_batch, slices, table, written
from scorewatch.llm.words import strings

MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Damage: one code point goes from runs whose checksum this divides.
DAMAGE = 31
BLOCK, BLOCK_CELLS = 128, 1 << 22
TILE = 4_096
#: Distinct words a task adds up before it passes them on.
KEPT_WORDS = 300_000

_NO_LETTER = r"[^A-Za-z\x{C0}-\x{FF}]+"


def damaged_counts(docs: pa.RecordBatch) -> Counter:
    """Counts of the words of a batch (doc_id, text): runs of letters in lower case (A-Z only), one
    code point less where `DAMAGE` divides the checksum of `<doc_id>:<run>`, of MIN_LENGTH or more."""
    texts = pc.fill_null(docs.column("text"), "")
    lists = pc.split_pattern_regex(texts, _NO_LETTER)
    runs = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    long = pc.greater_equal(pc.utf8_length(runs), MIN_LENGTH)
    coded = pc.ascii_lower(runs.filter(long)).dictionary_encode()
    owner = owner[long.to_numpy(zero_copy_only=False)]
    words = strings(coded.dictionary)
    raw = [w.encode() for w in words]
    begun = [zlib.crc32(b"%s:" % (b"" if i is None else b"%d" % i)) for i in docs.column("doc_id").to_pylist()]
    both, n = np.unique(owner * np.int64(max(1, len(words))) + coded.indices.to_numpy(), return_counts=True)
    doc, word = np.divmod(both, max(1, len(words)))
    # A checksum goes on where that of the beginning has ended.
    h = np.fromiter(map(zlib.crc32, map(raw.__getitem__, word.tolist()), map(begun.__getitem__, doc.tolist())), np.int64, len(both))
    hit = h % DAMAGE == 0
    whole = np.bincount(word[~hit], weights=n[~hit], minlength=len(words)).astype(np.int64).tolist()
    out = Counter({w: k for w, k in zip(words, whole, strict=True) if k})
    for c, k, x in zip(word[hit].tolist(), n[hit].tolist(), h[hit].tolist(), strict=True):
        w = words[c]
        if len(w) > MIN_LENGTH:
            out[w[:x % len(w)] + w[x % len(w) + 1:]] += k
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: Counter = Counter()
    for b in slices(batches, "text"):
        kept.update(damaged_counts(b))
        if len(kept) > KEPT_WORDS:
            yield _word_rows(kept)
            kept = Counter()
    if kept:
        yield _word_rows(kept)


def _word_rows(kept: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array(list(kept), pa.string()), "n": pa.array(list(kept.values()), pa.int64())})


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words that occur MIN_COUNT times or more."""
    parts = docs.select("doc_id", "text").mapInArrow(_count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def half(longer):
    """The length that the prefix or the suffix reaches: half of longer - 1, rounded up."""
    return longer // 2


def met(words: DataFrame) -> DataFrame:
    """(word, n, longer, left, key): every word under its prefix and its suffix, as the longer one
    of a pair or of equal length (longer = its length), and as the shorter one."""
    length = F.length("word")
    one = lambda more, left: F.struct(
        (length + more).alias("longer"), F.lit(left).alias("left"),
        F.xxhash64(F.expr(f"left(word, (length(word) + {more}) div 2)" if left else f"right(word, (length(word) + {more}) div 2)"), F.lit(left), length + more).alias("key"))
    return words.select("word", "n", F.explode(F.array(*[one(m, s) for m in (0, 1) for s in (True, False)])).alias("m")).select("word", "n", "m.*")


def dealt(rows: DataFrame) -> DataFrame:
    """`rows` with the two tiles that meet (a, b) and the tile a row belongs to: one tile for a
    group of up to TILE words, else every row stands in all pairs that its tile is part of."""
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > TILE)
    tiles = F.ceil(F.coalesce("size", F.lit(0)) / TILE).cast("int")
    out = rows.join(large, "key", "left").withColumn("tiles", tiles)
    own = F.when(F.col("tiles") > 1, F.pmod(F.xxhash64("word"), "tiles")).otherwise(0).cast("int")
    pairs = F.when(F.col("tiles") > 1, F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least("tile", t).alias("a"), F.greatest("tile", t).alias("b")))
                   ).otherwise(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))))
    return (out.withColumn("tile", own).withColumn("pair", F.explode(pairs))
            .select("word", "n", "longer", "left", "key", "tile", F.col("pair.a").alias("a"), F.col("pair.b").alias("b")))


class Block:
    """Rows of one or more groups: words as columns of code points, from the left and from the right."""

    def __init__(self, rows: dict):
        self.words, self.n, self.group, self.cross = rows["word"], rows["n"], rows["group"], rows["cross"]
        self.longer, self.left, self.tile = rows["longer"], rows["is_left"], rows["tile"]
        self.length = np.fromiter(map(len, self.words), np.int64, len(self.words))
        width = int(self.length.max())
        # Letters lie below 256. Zeros pad, and pads never count as common: prefixes end with the shorter word.
        flat = b"".join(w.encode("latin-1").ljust(width, b"\0") for w in self.words)
        back = b"".join(w.encode("latin-1")[::-1].ljust(width, b"\0") for w in self.words)
        self.front, self.back = (np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(-1, width).T) for x in (flat, back))


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of every column of `a` with every column of `b`."""
    total = np.zeros((a.shape[1], b.shape[1]), np.int32)
    alive = np.ones(total.shape, bool)
    for x, y in zip(a, b, strict=False):
        alive &= (x[:, None] == y[None, :]) & (x[:, None] > 0)
        if not alive.any():
            break
        total += alive
    return total


def near_pairs(a: Block, b: Block, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `a` and rows of `b` one edit apart that meet in a group and are reported there."""
    ok = (a.group[:, None] == b.group[None, :]) & (~a.cross[:, None] | (a.tile[:, None] != b.tile[None, :]))
    if same:
        ok &= np.arange(len(a.words))[:, None] < np.arange(len(b.words))[None, :]
    longer = np.maximum(a.length[:, None], b.length[None, :])
    ok &= longer == a.longer[:, None]
    if not ok.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    prefix = common(a.front, b.front)
    ok &= (prefix >= half(longer)) == a.left[:, None]
    if not ok.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ok &= prefix + common(a.back, b.back) >= longer - 1
    return np.nonzero(ok)


_NEAR = pa.schema([("word", pa.string()), ("other", pa.string()), ("other_n", pa.int64())])


def _reported(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    i, j = i.tolist(), j.tolist()
    left, right = [a.words[x] for x in i], [b.words[x] for x in j]
    return as_batch(_NEAR, [left + right, right + left, [b.n[x] for x in j] + [a.n[x] for x in i]])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of sorted rows; `group` numbers the runs of rows that meet."""
    last, number = None, 0
    for whole in batches:
        for at in range(0, whole.num_rows, 4 * BLOCK):
            t = whole.slice(at, 4 * BLOCK)
            ids = np.stack([t.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("longer", "left", "key", "a", "b")], axis=1)
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]).any(axis=1)
            new[0] = last is None or (ids[0] != last).any()
            group = number + np.cumsum(new)
            last, number = ids[-1], int(group[-1])
            words = strings(t.column("word"))
            cross = ids[:, 3] != ids[:, 4]
            n, tile = t.column("n").to_pylist(), t.column("tile").to_numpy()
            start = 0
            while start < len(words):
                width = max(map(len, words[start:start + BLOCK]))
                stop = start + max(1, min(BLOCK, BLOCK_CELLS // width))
                s = slice(start, stop)
                yield Block({"word": words[s], "n": n[s], "group": group[s], "cross": cross[s], "longer": ids[s, 0], "is_left": ids[s, 1] > 0, "tile": tile[s]})
                start = stop


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every block against itself and against those before it that its first group reaches back to."""
    open_: list[Block] = []
    for b in _blocks(batches):
        open_ = [x for x in open_ if x.group[-1] == b.group[0]]
        for x in [*open_, b]:
            i, j = near_pairs(x, b, x is b)
            if len(i):
                yield _reported(x, b, i, j)
        open_.append(b)


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, best): number of near words, and the one of largest count as (less, word),
    for all words of `words` (word, n) that have any. `less` is its count below zero."""
    rows = dealt(met(words)).repartition("key", "a", "b").sortWithinPartitions("longer", "left", "key", "a", "b", "tile")
    pairs = rows.mapInArrow(_compare, "word string, other string, other_n long")
    return pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for `forms` (word, form): where the chain of forms ends. Every step doubles the
    way that a word has come; chains are at most log_RATIO(largest count) long."""
    out = forms.select("word", F.col("form").alias("root"))
    while True:
        step = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        out = written(out.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if out.where("moved").isEmpty():
            return out.select("word", "root")
        out = out.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of `docs` (doc_id, text)."""
    words = written(word_counts(docs), "spelling-words")
    best_n = -F.col("best.less")
    formed = F.when(best_n >= RATIO * F.col("n"), F.struct(F.col("best.word").alias("form"), best_n.alias("form_n")))
    found = words.join(near(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), formed.alias("f"))
    found = written(found.select("word", "n", "n_near", "f.form", "f.form_n"), "spelling-near")
    ends = roots(found.where("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def q_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


QUERIES = {"op11_spelling_variants": q_spelling}
ORACLE: dict[str, str] = {}
