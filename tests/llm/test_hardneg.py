"""Hard negatives against all pairs, summaries' bounds, odd tables."""

import math
import random

import numpy as np
import pytest

from vectorlint.llm import hardneg

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, row string, g string, anchor string"


def brute(rows):
    """(vec_id, embedding, label) rows with distinct ids."""
    use = []
    for i, e, l in rows:
        if l is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        use.append((i, (l + 1) % 10 if i is not None and i % 7 == 0 else l, [math.floor(256 * float(np.float32(x))) for x in e]))
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a in use:
        if a[0] is None or a[0] % 50:
            continue
        scored = [(sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in use if b is not a]
        for ps, p, _ in sorted((s for s in scored if s[2] == a[1]), key=key)[:5]:
            fit = sorted((s for s in scored if s[2] != a[1] and 50 * ps <= 100 * s[0] <= 95 * ps), key=key)[:3]
            out += [(a[0], str(p), k + 1, str(n), ps, ns) for k, (ns, n, _) in enumerate(fit)]
    return sorted(out)


def got(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, *"xxxx") for r in rows], SCHEMA).repartition(parts)
    return sorted((r.anchor_id, str(r.positive_id), r.rank, str(r.negative_id), r.positive_score, r.negative_score) for r in hardneg.mine(df).collect())


@pytest.mark.parametrize("chunk, bytes_", [(3, 2000), (256, 1 << 20)])
def test_against_all_pairs(spark, monkeypatch, chunk, bytes_):
    monkeypatch.setattr(hardneg, "ANCHORS", chunk)
    monkeypatch.setattr(hardneg, "ROWS", chunk * 5)
    monkeypatch.setattr(hardneg, "GROUP_BYTES", bytes_)
    monkeypatch.setattr(hardneg, "BLOCK_BYTES", bytes_ * 8)
    r = np.random.default_rng(chunk)
    base = r.normal(size=(6, 20)) / 4
    rows = [(i, (base[i % 6] + r.normal(size=20) / 3).tolist(), int(r.integers(4))) for i in range(400)]
    rows += [(400 + i, base[0].tolist(), i % 2) for i in range(200)]                        # one common vector, ties
    rows += [(600, [0.0] * 20, 1), (650, None, 1), (700, [1.0] * 20, None), (750, [float("nan")] + [1.0] * 19, 1), (800, [float("inf")] + [1.0] * 19, 1), (None, base[0].tolist(), 1),
             (850, [None] + [1.0] * 19, 1), (900, [0.5] * 3, 2), (950, [], 2), (-50, base[1].tolist(), 3)]
    assert got(spark, rows) == brute(rows)


def test_large_components(spark):
    """Scores beyond what doubles hold exactly."""
    r = random.Random(5)
    rows = [(i, [float(np.float32(r.random() * 1e6)) for _ in range(8)], i % 3) for i in range(0, 300, 5)]
    assert got(spark, rows) == brute(rows)


def test_repeated_rows(spark):
    """A repeated anchor is a row of its own, and the other's positive."""
    rows = [(50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (3, [0.7, 0.1], 2)]
    assert got(spark, rows, 1) == [(50, "50", 1, "3", 65536, 256 * 179)] * 2
    assert got(spark, rows[2:]) == [] and hardneg.mine(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bounds():
    r = np.random.default_rng(1)
    x = r.integers(-99, 99, (60, 37)).astype(float)
    exact = x @ x.T
    spans = []
    for m, d in hardneg.summaries(x):
        assert (exact <= m @ m.T + d @ d.T + 1e-6).all() and (exact >= m @ m.T - d @ d.T - 1e-6).all()
        spans.append((d @ d.T).mean())
    assert spans == sorted(spans, reverse=True)
