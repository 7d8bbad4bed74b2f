"""Weights updated until the AUC stops rising, against plain Python."""

import math
import random

import pytest

from scorewatch.operators import ensemble as EN


def auc(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def plain(rows, n, updates, patience, delta, min_n=100):
    models = sorted({r[1] for r in rows})
    by = {m: sorted((i, y, p) for i, mm, y, p in rows if mm == m) for m in models}
    own = {m: auc([(y, p) for _, y, p in by[m]]) for m in models}
    w, best, misses, held, out = {m: 1 / len(models) for m in models}, -math.inf, 0, {m: [] for m in models}, []
    for u in range(updates):
        score = {}
        for m in models:
            for i, y, p in by[m]:
                score.setdefault((i, y), 0.0)
                score[i, y] += w[m] * p
        a = auc([(y, min(p, 1.0)) for (_, y), p in score.items()])
        best, misses = (a, 0) if a > best + delta else (best, misses + 1)
        out.append((u, dict(w), a, misses >= patience))
        if misses >= patience:
            break
        s = {}
        for m in models:
            held[m] = (held[m] + [(p - y) ** 2 for _, y, p in by[m]])[-n:]
            s[m] = 0.6 * own[m] + 0.4 / ((sum(held[m]) / len(held[m]) if len(held[m]) >= min_n else 0.0) + 1e-8)
        top = max(s.values())
        z = sum(math.exp(x - top) for x in s.values())
        x = {m: max(0.9 * w[m] + 0.1 * math.exp(s[m] - top) / z, 0.05) for m in models}
        w = {m: v / sum(x.values()) for m, v in x.items()}
    return out


@pytest.mark.parametrize("rows, n, updates, patience, delta", [(60, 100, 9, 3, 0.0), (60, 1000, 12, 5, 0.001), (300, 130, 7, 20, 0.0), (40, 7, 3, 2, 0.5), (50, 100, 1, 3, 0.0)])
def test_updates_stop_when_the_auc_does(spark, rows, n, updates, patience, delta):
    rnd = random.Random(rows + n)
    data = []
    for i in range(rows):
        y = int(rnd.random() < 0.4)
        for m, noise in (("a", 0.9), ("b", 0.5), ("c", 0.2)):
            data.append((i, m, y, min(max((1 - noise) * y + noise * rnd.random(), 0.0), 1.0)))
    df = spark.createDataFrame(data, "id int, model_id string, label int, prob double").repartition(3)
    got = EN.early_stopped_updates(df, ["id"], "id", updates, patience, delta, n=n).collect()
    want = plain(data, n, updates, patience, delta)
    assert len(got) == 3 * len(want)
    mine = {(r["update"], r.model_id): r for r in got}
    for u, w, a, stopped in want:
        for m, v in w.items():
            r = mine[u, m]
            assert r.weight == pytest.approx(v) and r.auc_roc == pytest.approx(a) and r.stopped == stopped
