"""Operator 12 against an exhaustive comparison with every entry, and against its SQL."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np

from media_forecast.llm import vector_codes as V


def brute(rows, entries):
    """Rows of the contract from comparing every part with every entry, in Python integers."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v], lab) for i, v, lab in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4
    books = [[r[1][p * w: p * w + w] for r in kept[:entries]] for p in range(4)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(e, v, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(4):
        for p in range(4):
            groups = {}
            for _, x, _ in kept:
                v = x[p * w: p * w + w]
                groups.setdefault(nearest(p, v)[1], []).append(v)
            for k, vs in groups.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, total = [], {}
    for i, x, lab in kept:
        found = [nearest(p, x[p * w: p * w + w]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
        total[lab] = total.get(lab, 0) + out[-1][2]
    return sorted(((i, c, e, total[lab], digest) for i, c, e, lab in out), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, x string").repartition(3)


def test_equal_to_exhaustive_search(spark, monkeypatch):
    r = random.Random(2)
    rows = [(k, [r.choice((-0.5, -0.001, 0.0, 0.25, r.gauss(0, 1))) for _ in range(8)], r.choice((0, 1, None))) for k in range(300)]
    rows += [(7, rows[7][1], 1), (7, rows[9][1], 0), (None, rows[3][1], 2), (None, rows[3][1], 2)]  # repeats, ties, null ids
    rows += [(400, None, 0), (401, [1.0, None] * 4, 0), (402, [math.nan] * 8, 0), (403, [math.inf] * 8, 0), (404, [0.0] * 8, 5)]
    for entries in (1, 5, 256):
        monkeypatch.setattr(V, "ENTRIES", entries)
        assert sorted(map(tuple, V.compress(frame(spark, rows)).collect()), key=str) == brute(rows, entries)
    few = rows[:3]
    assert sorted(map(tuple, V.compress(frame(spark, few)).collect()), key=str) == brute(few, 256)


def test_search_is_exact_and_stops_early():
    g = np.random.default_rng(1)
    entries = g.integers(-40, 40, (64, 2))
    entries[10] = entries[3]  # equal entries: the lower index wins
    x = g.integers(-60, 60, (500, 2))
    best, d = V.Codebook(entries).search(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(-1)
    assert (best == every.argmin(1)).all() and (d == every.min(1)).all()


def test_odd_vectors(spark):
    rows = [(1, [0.5, 1.0, 2.0, 3.0, 4.0], 1), (2, [1.5, 1.0, 2.0, 3.0, 4.0], 1), (3, [1.0], 1), (4, [], 2), (5, [1e30] * 5, None)]
    got = {x.vec_id: (x.code, x.error, x.label_error) for x in V.compress(frame(spark, rows)).collect()}
    assert got == {1: ("00000000", 0, 0), 2: ("01000000", 0, 0), 3: (None, None, 0), 4: (None, None, None), 5: (None, None, None)}
    assert V.compress(frame(spark, rows).limit(0)).count() == 0
    assert [tuple(x)[:3] for x in V.compress(frame(spark, [(1, [], 1)])).collect()] == [(1, "00000000", 0)]
    assert [tuple(x)[:3] for x in V.compress(frame(spark, [(1, [1e30], 1)])).collect()] == [(1, None, None)]
