"""Quality rules: base word rules, then a hashed n-gram log-likelihood ratio.

Two multinomials over `BUCKETS` hashed token unigrams and bigrams are counted on all
documents: one on the trusted target (labelled of good quality and not toxic), one on the
raw corpus. A document's score is the mean over its n-grams of
log p_target(bucket) - log p_raw(bucket), so its length does not matter. A document is
kept if it passes the base rules and its score is at least the threshold: one number,
the cut on a fixed grid of scores with the least weighted error on all labelled documents
that pass the base rules: a wrongly rejected share of the trusted ones weighs `REJECT_COST`
times a wrongly kept share of the others, toxic ones among them. A trusted document has helped to
count its own n-grams, so the cut is fitted on scores by a target without the documents of its
own fold (`FOLDS`, by the text); all documents are then judged by the whole target.

Tokens of the n-grams are words cut at the border of letters/digits and other signs.

Defined cases: null or empty text has no words and fails the base rules; without trusted
labels both multinomials are equal and every score is 0; without labels of both kinds the
threshold is minus infinity and only the base rules decide; several labels of one doc_id
count as good only if all are; a null doc_id has no label. Repeated rows are judged alike.
An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm.common import as_batch, bundled, extended, slices, table, unbundled, written
from scorewatch.llm.words import mix, positions, split_words, window_hashes, word_hashes

BUCKETS, FOLDS = 1 << 16, 5
SMOOTHING = 1.0
REJECT_COST = 20.0
GRID = 100  # cuts per unit of score
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SIGNS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
PART = 256  # count rows hold this many buckets
SLICE = 2 << 20  # text bytes at a time: words cut at signs are many, and an executor's memory is shared


def _base(texts: pa.Array) -> dict[str, np.ndarray]:
    counts, codes, _ = split_words(texts)
    n_docs = len(texts)
    owner, place = positions(counts)
    # Words in 3-word windows found twice or more in the text.
    at = np.flatnonzero(place + 3 <= counts[owner])
    repeat = np.zeros(n_docs, np.int64)
    if len(at):
        h = np.zeros(len(at), np.uint64)
        for k in range(3):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[at + k].astype(np.uint64) + np.uint64(1))
        h = mix(h + owner[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))  # told apart by document
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(codes) + 3, bool)
        for k in range(3):
            covered[at[twice] + k] = True
        repeat = np.bincount(owner[covered[:len(codes)]], minlength=n_docs)
    word_chars, symbols, dup = (np.zeros(n_docs, np.int64) for _ in range(3))
    for i, t in enumerate(texts.to_pylist()):
        if t:
            raw = t.encode()
            word_chars[i] = len(t) - (len(raw) - len(raw.translate(None, SPACE)))
            symbols[i] = len(raw) - len(raw.translate(None, SIGNS))
            if b"\n" in raw:
                lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
                dup[i] = len(lines) - len(set(lines))
    return {"n_words": counts, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat}


def _buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all token unigrams and bigrams, and their rows."""
    cut = pc.replace_substring_regex(pc.fill_null(texts, ""), r"([^\pL\pN\s]+)", r" \1 ")
    counts, codes, dictionary = split_words(cut)
    h = word_hashes(dictionary)[codes]
    pair, owner = window_hashes(h, counts, 2)
    both = np.concatenate([mix(h), pair])
    return (both >> np.uint64(48)).astype(np.int64) % BUCKETS, np.concatenate([positions(counts)[0], owner])


def _folds(texts: pa.Array) -> np.ndarray:
    """Fold of each text, equal for copies."""
    return np.fromiter((zlib.crc32((t or "").encode()) % FOLDS for t in texts.to_pylist()), np.int64, len(texts))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros((FOLDS, BUCKETS), np.int64)
    for b in slices(batches, "text", SLICE):
        text = b.column("text")
        bucket, owner = _buckets(text)
        good = pc.fill_null(b.column("trusted"), False).to_numpy(zero_copy_only=False)
        raw += np.bincount(bucket, minlength=BUCKETS)
        use = good[owner]
        target += np.bincount(_folds(text)[owner[use]] * BUCKETS + bucket[use], minlength=FOLDS * BUCKETS).reshape(FOLDS, BUCKETS)
    if raw.any():
        schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("counts", pa.list_(pa.int64()))])
        parts = BUCKETS // PART
        for kind, counts in enumerate((raw, *target)):
            if counts.any():
                values = pa.ListArray.from_arrays(pa.array(np.arange(parts + 1) * PART, pa.int32()), pa.array(counts))
                yield as_batch(schema, [np.full(parts, kind, np.int32), np.arange(parts, dtype=np.int32), values])


def log_ratio(docs: DataFrame) -> np.ndarray:
    """Log-ratio of every bucket from all rows of `docs` (text, trusted): with the whole target, then without
    each fold of it. Each task adds up its own counts; `BUCKETS` sums reach the driver, whatever
    the size of the corpus."""
    total = F.array(*[F.sum(F.col("counts")[k]) for k in range(PART)]).alias("counts")
    sums = docs.mapInArrow(_count, "kind int, part int, counts array<long>").groupBy("kind", "part").agg(total)
    all_ = np.zeros((FOLDS + 1, BUCKETS))
    for r in sums.collect():
        all_[r["kind"], r["part"] * PART:(r["part"] + 1) * PART] = r["counts"]
    raw, target = all_[0], all_[1:]
    if not target.any():
        return np.zeros((FOLDS + 1, BUCKETS))
    share = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS))
    return np.array([share(t) - share(raw) for t in (target.sum(axis=0), *(target.sum(axis=0) - t for t in target))])


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, fit_score double"


def _measure(ratio: np.ndarray, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            text = b.column("text")
            m = _base(text)
            bucket, owner = _buckets(text)
            n = np.maximum(np.bincount(owner, minlength=len(text)), 1)
            mean = lambda x: pa.array(np.bincount(owner, weights=x, minlength=len(text)) / n)  # noqa: B023, E731
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
            cols = {k: b.column(k) for k in keep} | {k: pa.array(v) for k, v in m.items()} | {"base_failed": pa.array(failed)}
            yield pa.RecordBatch.from_pydict(cols | {"score": mean(ratio[0][bucket]), "fit_score": mean(ratio[1 + _folds(text)[owner], bucket])})

    return run


def measures(docs: DataFrame, ratio: np.ndarray, keep: list[str]) -> DataFrame:
    """Columns `keep` of every row of `docs`, its base measures, its score, and the one without its own fold."""
    cols = list(dict.fromkeys([*keep, "text"]))
    return docs.select(*cols).mapInArrow(_measure(ratio, keep), extended(docs.select(*keep).schema, MEASURES))


def labels_by_doc(labels: DataFrame) -> DataFrame:
    """(doc_id, trusted), one row per labelled doc_id: of good quality and not toxic by all its labels. Rows
    without a quality label do not count."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    clean = (F.min("quality") == 1) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)
    return rows.groupBy("doc_id").agg(clean.alias("trusted"))


def threshold(measured: DataFrame, labels: DataFrame) -> float:
    """The cut on a grid of 1/GRID with least weighted error over all labelled rows; the middle
    of the best cuts that lie together. Only counts per grid cell reach the driver, and scores
    lie within +-log of the n-gram total, so the cells are bounded."""
    cells = (measured.where(~F.col("base_failed")).join(labels, "doc_id")
             .groupBy(F.floor(F.col("fit_score") * GRID).alias("cell")).agg(
                 F.sum(F.col("trusted").cast("long")).alias("good"), F.sum((~F.col("trusted")).cast("long")).alias("bad")).orderBy("cell").collect())
    good, bad = sum(r["good"] for r in cells), sum(r["bad"] for r in cells)
    if not good or not bad:
        return -math.inf
    by = {r["cell"]: r for r in cells}
    lost, held, costs = 0, bad, []
    for cut in range(min(by), max(by) + 2):  # keep scores of cells at or above the cut
        costs.append((round(REJECT_COST * lost / good + held / bad, 9), cut))
        r = by.get(cut, {"good": 0, "bad": 0})
        lost, held = lost + r["good"], held - r["bad"]
    best = min(costs)
    last = best[1]
    while (best[0], last + 1) in set(costs[last + 1 - costs[0][1]:][:1]):
        last += 1
    return (best[1] + last) / 2 / GRID


def judged(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` (doc_id among them) of every document, its measures, and `kept`."""
    lab = labels_by_doc(labels)
    # Labels grow with the documents: neither side is broadcast, whatever its size.
    ratio = log_ratio(docs.select("doc_id", "text").join(lab.hint("merge"), "doc_id", "left").select("text", "trusted"))
    measured = written(measures(docs, ratio, keep), "quality-measures")
    cut = threshold(measured, lab)
    return measured.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= cut))


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with their columns."""
    rows = bundled(docs).withColumn("doc_id", F.col("row.doc_id"))
    return unbundled(judged(rows, labels, ["row", "doc_id", "text"]).where("kept"), docs.columns)


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


QUERIES = {"op3_ngram_quality": q_quality}
ORACLE: dict[str, str] = {}
