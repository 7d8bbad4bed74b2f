"""Keyed last-N calibration monitor (#140) with `transformWithStateInPandas`.

Tasks keep at most n rows of a key before the shuffle. A key's rows live in chunks of the state's map,
in order, next to an index with each chunk's beginning, length and sum of squared errors. A
micro-batch reads and writes only the chunks that its rows fall into, drops whole chunks from
the old end and cuts the oldest one; the monitor's value comes from the index alone. The state of
a key is bounded by n rows and a chunk.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHUNK = 128
#: Rows that a task holds while it keeps the last n of each key.
HELD_ROWS = 100_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ORDER = ["order_1", "order_2"]


def last_rows(key: str, n: int):
    """The last n rows of each key of a task, with how many rows stand for (`rows_held`, on one row a key)."""
    def reduce(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([key, *_ORDER], kind="stable")
        rows = frame.groupby(key, dropna=False)["rows_held"].transform("sum")
        place = frame.groupby(key, dropna=False).cumcount(ascending=False)
        frame = frame.assign(rows_held=np.where(place == 0, rows, 0))
        return frame[place < n]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            held.append(f)
            if sum(map(len, held)) > HELD_ROWS:
                held = [reduce(pd.concat(held, ignore_index=True))]
                if len(held[0]) > HELD_ROWS // 2:  # many keys: nothing left to save
                    yield held.pop()
        if held:
            yield reduce(pd.concat(held, ignore_index=True))

    return run


class LastN(StatefulProcessor):
    """Emits (key, n_window, rolling_brier, rows_seen) for every key of a micro-batch."""

    def __init__(self, key: str, n: int, min_n: int):
        self.key, self.n, self.min_n = key, n, min_n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", "chunk long", "o1 array<long>, o2 array<long>, sq array<double>")
        self.index = handle.getValueState("index", "ids array<long>, o1 array<long>, o2 array<long>, counts array<long>, sums array<double>, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ids, first, counts, sums, seen = [], [], [], [], 0
        if self.index.exists():
            a, b, c, d, e, seen = self.index.get()
            ids, first, counts, sums = list(a), list(zip(b, c, strict=True)), list(d), list(e)
        new: list[tuple] = []
        for f in rows:
            seen += int(f["rows_held"].sum())
            new += zip(f["order_1"].tolist(), f["order_2"].tolist(), f["sq_error"].tolist(), strict=True)
        new = sorted(new)[-self.n:]
        # Rows by the chunk they fall into; older ones than all chunks go to the first.
        into: dict[int, list[tuple]] = {}
        for r in new:
            into.setdefault(max(0, bisect.bisect_right(first, r[:2]) - 1) if first else -1, []).append(r)
        fresh = max(ids, default=-1) + 1
        for at in sorted(into, reverse=True):
            merged = into[at]
            if at >= 0:
                o1, o2, sq = self.chunks.getValue((ids[at],))
                merged = sorted([*zip(o1, o2, sq, strict=True), *merged])
            parts = [merged[i:i + CHUNK] for i in range(0, len(merged), CHUNK)]
            names = ([ids[at]] if at >= 0 else [fresh]) + list(range(fresh + 1, fresh + len(parts)))
            fresh += len(parts)
            for name, part in zip(names, parts, strict=True):
                self.chunks.updateValue((name,), tuple(map(list, zip(*part, strict=True))))
            where = slice(at, at + 1) if at >= 0 else slice(0, 0)
            ids[where], first[where] = names, [p[0][:2] for p in parts]
            counts[where], sums[where] = [len(p) for p in parts], [float(sum(x[2] for x in p)) for p in parts]
        while ids and sum(counts) - counts[0] >= self.n:
            self.chunks.removeKey((ids[0],))
            ids, first, counts, sums = ids[1:], first[1:], counts[1:], sums[1:]
        if (over := sum(counts) - self.n) > 0:
            kept = [list(x)[over:] for x in self.chunks.getValue((ids[0],))]
            self.chunks.updateValue((ids[0],), tuple(kept))
            first[0], counts[0], sums[0] = (kept[0][0], kept[1][0]), len(kept[0]), float(sum(kept[2]))
        self.index.update((ids, [x for x, _ in first], [x for _, x in first], counts, sums, seen))
        have = int(sum(counts))
        yield pd.DataFrame({self.key: [key[0]], "n_window": [have], "rolling_brier": [sum(sums) / have if have >= self.min_n and have else 0.0], "rows_seen": [seen]})

    def close(self) -> None:
        pass


def last_n_monitor(stream: DataFrame, key: str, order: Sequence[str] = ("ts", "event_id"), n: int = 1000,
                   min_n: int = 100, label: str = "label", prob: str = "prob") -> DataFrame:
    """#140: after each micro-batch (key, n_window, rolling_brier, rows_seen) over the newest n pairs by
    `order` (two integral or timestamp columns); 0.0 below min_n pairs. Needs the RocksDB state store."""
    if n <= 0:
        raise ValueError("n must be positive")
    kinds = dict(stream.dtypes)
    whole = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if "timestamp" in kinds[c] else F.col(c).cast("bigint")
    y = F.col(label).cast("double")
    s = stream.select(F.col(key).cast("string").alias(key), whole(order[0]).alias("order_1"), whole(order[1]).alias("order_2"),
                      ((F.col(prob) - y) * (F.col(prob) - y)).alias("sq_error"), F.lit(1).cast("bigint").alias("rows_held")).where("sq_error IS NOT NULL")
    few = s.mapInPandas(last_rows(key, n), s.schema)
    return few.groupBy(key).transformWithStateInPandas(
        LastN(key, n, min_n), f"`{key}` string, n_window bigint, rolling_brier double, rows_seen bigint", "Update", "None")
