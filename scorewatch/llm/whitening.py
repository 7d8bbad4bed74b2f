"""Whitening of integer-quantised vectors from exact cross-products of bit planes.

Components become integers x = floor(64 c) + 1000000. The fit list holds each distinct x
vector once. Its cross-products are counted, not multiplied: a block of vectors is shifted by
the least entry of each dimension, every bit plane of every dimension is packed across the
rows into 64-bit words, and the popcount of the AND of two planes, weighted by 2^(a + b), is
the share of bits a and b in the cross-product of their dimensions. Shifts are undone in
integers, and tasks send their sums in limbs of 32 bits, so sums of any size are exact.
n sum(xy) - sum(x) sum(y) is centred as an integer; only then V becomes doubles for `eigh`.
Where the wanted eigenvalues span more than `SPAN`, which rounding in `eigh` would blur, the
integer matrix is diagonalised by Jacobi rotations in long decimals instead.

A task holds one block of vectors and the sums; the driver gets sums by pair of dimensions and
a few sums by pair of components, whatever the number of rows.

Defined cases: null vectors and vectors with a null or non-finite entry take no part (nor do
entries so large that 64 c is no finite double); shorter vectors count as padded with zeros;
repeated rows and ids are rows of their own, and equal vectors count once in the fit; entries of
any size are exact; components without variance are left out, so fewer than `COMPONENTS` come
back where the fit list spans less, and none for one distinct vector or an empty table; a
deviation beyond 64 bits is null in `deviation` and whole, as digits, in `deviation_digits`.
Other columns come back in `row`, so names cannot clash.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.llm.common import as_batch, extended, table, written

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 16
#: Rows of a block of bit planes.
BLOCK = 8_192
LIMB = 32
SPAN = 1e9
#: Whitened rows that leave a task at a time.
OUT_ROWS = 2_048

_WIDTHS = ((1, np.int8), (2, np.int16), (4, np.int32))


def key_of(y: np.ndarray) -> bytes:
    """One string of bytes for one vector of whole doubles: its entries, without zeros at the end,
    in the narrowest integers that hold all, or as doubles."""
    y = y[:np.flatnonzero(y)[-1] + 1] if y.any() else y[:0]
    for width, kind in _WIDTHS:
        if (np.abs(y) < 2 ** (8 * width - 1)).all():
            return bytes([width]) + y.astype(kind).tobytes()
    return b"\x08" + y.tobytes()


def keys_of(y: np.ndarray) -> list[bytes]:
    """`key_of` for every row of a matrix."""
    plain = (np.abs(y) < 128).all(axis=1) & (y[:, -1:] != 0).all(axis=1) if y.shape[1] else np.zeros(len(y), bool)
    raw, width = y.astype(np.int8, casting="unsafe") if plain.all() else np.where(plain[:, None], y, 0).astype(np.int8), y.shape[1]
    flat = raw.tobytes()
    return [b"\x01" + flat[i * width:(i + 1) * width] if plain[i] else key_of(y[i]) for i in range(len(y))]


def vectors_of(keys: list[bytes], dims: int) -> np.ndarray:
    """The vectors of keys as a matrix of whole doubles."""
    if keys and all(len(k) == dims + 1 and k[0] == 1 for k in keys):
        return np.frombuffer(b"".join(keys), np.int8).reshape(-1, dims + 1)[:, 1:].astype(np.float64)
    out = np.zeros((len(keys), dims))
    kinds = dict(_WIDTHS) | {8: np.float64}
    for i, k in enumerate(keys):
        y = np.frombuffer(k, kinds[k[0]], offset=1)
        out[i, :len(y)] = y
    return out


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = b.column("vec")
        b = b.filter(pc.is_valid(v))
        v = b.column("vec")
        counts = pc.list_value_length(v).to_numpy().astype(np.int64)
        flat = v.flatten().cast(pa.float64())
        with np.errstate(over="ignore", invalid="ignore"):
            y = np.floor(SCALE * flat.to_numpy(zero_copy_only=False)) + 0.0
        ok = np.isfinite(y)  # nulls come as NaN
        owner = np.repeat(np.arange(len(counts)), counts)
        good = np.bincount(owner[~ok], minlength=len(counts)) == 0
        keys: list = [None] * len(counts)
        starts = np.cumsum(counts) - counts
        for width in np.unique(counts[good]):
            rows = np.flatnonzero(good & (counts == width))
            for i, k in zip(rows.tolist(), keys_of(y[starts[rows][:, None] + np.arange(width)]), strict=True):
                keys[i] = k
        out = pa.RecordBatch.from_pydict({"row": b.column("row"), "key": pa.array(keys, pa.binary()), "dims": pa.array(counts.astype(np.int32))})
        yield out.filter(pa.array(good))


def quantised(rows: DataFrame, vector: str) -> DataFrame:
    """(row, key, dims) of the rows that take part."""
    others = [c for c in rows.columns if c != vector]
    both = rows.select(F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(None).cast("int").alias("_")]).alias("row"), F.col(f"`{vector}`").alias("vec"))
    return both.mapInArrow(_quantise, extended(both.select("row").schema, "key binary, dims int"))


def bit_planes(u: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """(planes, weights, dims): every bit plane with a set bit of a matrix of non-negative
    integers, packed across rows into words; its power of two and its dimension. Ordered by dimension."""
    pad = -len(u) % 64
    planes, weights, dims = [], [], []
    wide = u.dtype == object
    for d in range(u.shape[1]):
        col = u[:, d]
        every = np.bitwise_or.reduce(col) if len(col) else 0
        for a in range(int(every).bit_length()):
            if int(every) >> a & 1:
                bits = np.fromiter((x >> a & 1 for x in col), np.uint8, len(col)) if wide else (col >> a & 1).astype(np.uint8)
                planes.append(np.packbits(np.pad(bits, (0, pad))).view(np.uint64))
                weights.append(a)
                dims.append(d)
    return np.array(planes, np.uint64).reshape(len(planes), (len(u) + pad) // 64), weights, np.array(dims, np.int64)


def cross_products(u: np.ndarray) -> np.ndarray:
    """u'u of a matrix of non-negative integers as Python integers, by weighted AND-popcounts."""
    planes, weights, dims = bit_planes(u)
    n, width = len(planes), u.shape[1]
    total = np.zeros((width, width), object)
    if not n:
        return total
    both = np.zeros((n, n), np.int64)
    for p in range(n):
        both[p, p:] = np.bitwise_count(planes[p] & planes[p:]).sum(axis=1, dtype=np.int64)
    both += np.triu(both, 1).T
    small = 2 * max(weights) + len(u).bit_length() + 2 * (max(weights) + 1).bit_length() < 62
    w = np.array([1 << a for a in weights], np.int64 if small else object)
    both = (both if small else both.astype(object)) * w[:, None] * w
    present, first = np.unique(dims, return_index=True)
    sums = np.add.reduceat(np.add.reduceat(both, first, axis=0), first, axis=1)
    total[np.ix_(present, present)] = sums.astype(object)
    return total


def integers(y: np.ndarray) -> np.ndarray:
    """Whole doubles as integers: 64-bit ones where all fit well, else Python's."""
    if not y.size or np.abs(y).max() < 2.0**40:
        return y.astype(np.int64)
    return np.array([int(v) for v in y.ravel()], object).reshape(y.shape)


def block_sums(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, cross-products) of a block of whole doubles, exact."""
    x = integers(y)
    least = x.min(axis=0)
    u = x - least
    s, m, k = u.sum(axis=0).astype(object), least.astype(object), len(x)
    cross = cross_products(u) + np.outer(m, s) + np.outer(s, m) + k * np.outer(m, m)
    return s + k * m, cross


def limbs(value: int) -> list[tuple[int, int]]:
    """(limb, signed value) of an integer to the base 2^LIMB, without zeros."""
    sign, value, out = (-1, -value, []) if value < 0 else (1, value, [])
    for k in range(-(-value.bit_length() // LIMB)):
        if v := value >> LIMB * k & (1 << LIMB) - 1:
            out.append((k, sign * v))
    return out


_SUMS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("limb", pa.int32()), ("v", pa.int64())])


def _scatter(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                y = vectors_of(b.column("key").slice(at, BLOCK).to_pylist(), dims)
                s, c = block_sums(y)
                n, sums, cross = n + len(y), sums + s, cross + c
        if n:
            entries = [(-1, -1, n), *((i, -1, v) for i, v in enumerate(sums)), *((i, j, cross[i, j]) for i in range(dims) for j in range(i, dims))]
            rows = [(i, j, k, v) for i, j, x in entries for k, v in limbs(int(x))]
            yield as_batch(_SUMS, list(map(list, zip(*rows, strict=True))))

    return run


def scatter(fit: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sums, n * cross-products - products of sums) of the fit list, as Python integers."""
    parts = fit.mapInArrow(_scatter(dims), "i int, j int, limb int, v long").groupBy("i", "j", "limb").agg(F.sum("v").alias("v")).collect()
    n, sums, cross = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
    for r in parts:
        v = r.v << LIMB * r.limb
        if r.i < 0:
            n += v
        elif r.j < 0:
            sums[r.i] += v
        else:
            cross[r.i, r.j] += v
    cross = cross + np.triu(cross, 1).T
    return n, sums, n * cross - np.outer(sums, sums)


def jacobi(c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues of c / n^2, unit eigenvectors as columns) of a symmetric integer matrix by cyclic
    rotations in decimals long enough for all its digits."""
    size = len(c)
    digits = 40 + max(len(str(abs(int(v)))) for v in c.ravel())
    with decimal.localcontext(prec=digits, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN):
        one = decimal.Decimal(1)
        a = np.array([decimal.Decimal(int(v)) for v in c.ravel()], object).reshape(c.shape)
        q = np.array([one if i == j else one * 0 for i in range(size) for j in range(size)], object).reshape(c.shape)
        least = decimal.Decimal(10) ** -(digits - 20)
        for _ in range(60):
            turned = False
            for i in range(size):
                for j in range(i + 1, size):
                    if a[i, j] * a[i, j] <= least * abs(a[i, i] * a[j, j]) or abs(a[i, j]) < least:
                        continue
                    turned = True
                    theta = (a[j, j] - a[i, i]) / (2 * a[i, j])
                    t = one / (abs(theta) + (theta * theta + 1).sqrt()) * (1 if theta >= 0 else -1)
                    cos = one / (t * t + 1).sqrt()
                    sin = t * cos
                    a[i], a[j] = cos * a[i] - sin * a[j], sin * a[i] + cos * a[j]
                    a[:, i], a[:, j] = cos * a[:, i] - sin * a[:, j], sin * a[:, i] + cos * a[:, j]
                    q[:, i], q[:, j] = cos * q[:, i] - sin * q[:, j], sin * q[:, i] + cos * q[:, j]
            if not turned:
                break
        values = [a[i, i] / n / n for i in range(size)]
        top = max(values)
        values = [v if v > top * least else one * 0 for v in values]
        order = sorted(range(size), key=lambda i: -values[i])
        return np.array([float(values[i]) for i in order]), q[:, order].astype(np.float64)


def components(c: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors as columns, trace) of V = c / n^2, the largest `most` with variance."""
    trace = sum(int(c[i, i]) for i in range(len(c)))
    if not trace:
        return np.zeros(0), np.zeros((len(c), 0)), 0.0
    v = np.array([int(x) / (n * n) for x in c.ravel()]).reshape(c.shape)  # quotients of integers, rounded once
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    if e[0] > SPAN * max(e[min(most, len(e)) - 1], 0):
        e, q = jacobi(c, n)
    else:
        e = np.where(e > len(e) * np.finfo(float).eps * e[0], e, 0)
    some = int((e[:most] > 0).sum())
    return e[:some], np.ascontiguousarray(q[:, :some]), trace / (n * n)


class Whitener:
    """x -> whitened components, and exact squared distances from the mean."""

    def __init__(self, n: int, sums: np.ndarray, e: np.ndarray, q: np.ndarray, trace: float):
        self.n, self.sums, self.e, self.trace = n, sums, e, trace
        self.q = q / np.sqrt(e)

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * y - sums in integers; shifting every entry changes nothing."""
        x = integers(y)
        # All that the differences and their squares could reach must fit 63 bits.
        reach = 2 * self.n * max([1, *(abs(int(v)) for v in (x.max(initial=0), x.min(initial=0)))], default=1) + 2 * max((abs(int(s)) for s in self.sums), default=0)
        if x.dtype != object and reach < 2**62:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def deviations(self, c: np.ndarray) -> list[int]:
        if c.dtype != object and (not c.size or int(np.abs(c).max()) ** 2 * c.shape[1] < 2**62):
            return (c * c).sum(axis=1).tolist()
        return [sum(int(v) ** 2 for v in row) for row in c]

    def whitened(self, c: np.ndarray) -> np.ndarray:
        if c.dtype == object:
            y = np.array([int(v) / self.n for v in c.ravel()]).reshape(c.shape)
        else:
            y = c / self.n
        return y @ self.q


def _products(model: Whitener, dims: int):
    """Sums, and sums of products, of the whitened components of the fit list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(model.e)
        sums, both, any_row = np.zeros(m), np.zeros((m, m)), False
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                w = model.whitened(model.centred(vectors_of(b.column("key").slice(at, BLOCK).to_pylist(), dims)))
                sums, both, any_row = sums + w.sum(axis=0), both + w.T @ w, any_row or bool(len(w))
        if any_row:
            i, j = np.triu_indices(m)
            schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])
            yield as_batch(schema, [np.concatenate([np.arange(m), i]).astype(np.int32), np.concatenate([np.full(m, -1), j]).astype(np.int32), np.concatenate([sums, both[i, j]])])

    return run


def identity_error(fit: DataFrame, model: Whitener, dims: int) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    m = len(model.e)
    sums, both = np.zeros(m), np.zeros((m, m))
    for r in fit.mapInArrow(_products(model, dims), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if r.j < 0:
            sums[r.i] = r.v
        else:
            both[r.i, r.j] = both[r.j, r.i] = r.v
    mean = sums / model.n
    return float(np.abs(both / model.n - np.outer(mean, mean) - np.eye(m)).max(initial=0.0))


def _project(model: Whitener, dims: int, error: float):
    m = len(model.e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                b = batch.slice(at, OUT_ROWS)
                c = model.centred(vectors_of(b.column("key").to_pylist(), dims))
                dev, k = model.deviations(c), b.num_rows
                rows = pa.array(np.repeat(np.arange(k), m))
                yield pa.RecordBatch.from_pydict({
                    "row": b.column("row").take(rows),
                    "component": pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)),
                    "n": pa.array(np.full(k * m, model.n)),
                    "deviation": pa.array([d if d < 2**63 else None for d in dev], pa.int64()).take(rows),
                    "deviation_digits": pa.array(list(map(str, dev)), pa.string()).take(rows),
                    "whitened": pa.array(model.whitened(c).ravel()),
                    "explained": pa.array(np.tile(model.e / model.trace, k)),
                    "identity_error": pa.array(np.full(k * m, error))})

    return run


OUT = "component int, n long, deviation long, deviation_digits string, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: `row` with the other columns of `rows`, and `OUT`."""
    base = written(quantised(rows, vector), "whitening-rows")
    fit = written(base.select("key").distinct(), "whitening-fit")
    dims = base.agg(F.max("dims")).first()[0] or 0
    n, sums, c = scatter(fit, dims)
    e, q, trace = components(c, n, most) if n else (np.zeros(0), np.zeros((dims, 0)), 0.0)
    model = Whitener(n, sums, e, q, trace)
    return base.select("row", "key").mapInArrow(_project(model, dims, identity_error(fit, model, dims) if len(e) else 0.0), extended(base.select("row").schema, OUT))


def q_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits")


QUERIES = {"op13_whitening": q_whitening}
ORACLE: dict[str, str] = {}
