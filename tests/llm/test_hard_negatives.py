import math

import numpy as np
from pyspark.sql import functions as F

from driftspark.llm import hard_negatives as hn

VECS = "vec_id long, embedding array<double>, label int, v string, rank int"


def brute(rows, every=10):
    part = [(i, lab, tuple(math.floor(256 * x) for x in e)) for i, e, lab in rows if i is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    part = list(dict.fromkeys(part))
    out = []
    for a in part:
        if a[0] % every:
            continue
        score = lambda b: sum(x * y for x, y in zip(a[2], b[2]))  # noqa: B023, E731
        others = sorted((-score(b), b[0], b[1]) for b in part if b[0] != a[0] and len(b[2]) == len(a[2]))
        for p, pid, _ in [o for o in others if o[2] == a[1]][:5]:
            fits = [o for o in others if o[2] != a[1] and 80 * -p <= 100 * -o[0] <= 100 * -p][:5]
            out += [(a[0], pid, r + 1, o[1], -p, -o[0]) for r, o in enumerate(fits)]
    return sorted(out)


def run(spark, rows, every=10, **how):
    df = spark.createDataFrame([(i, e, lab, "x", 1) for i, e, lab in rows], VECS).repartition(3)
    got = hn.mine(hn.scaled(df), F.col("vec_id") % every == 0, **how)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


def fixture():
    rnd = np.random.default_rng(4)
    heart = rnd.normal(size=(12, 9)) / 3
    rows = [(i, (heart[i % 12] + 0.1 * rnd.normal(size=9)).tolist(), int(rnd.integers(4))) for i in range(400)]
    rows += [(500 + i, heart[0].tolist(), 1) for i in range(40)] + [(600 + i, heart[0].tolist(), 2) for i in range(40)]  # copies and ties
    rows += [(700, None, 1), (710, [None] * 9, 1), (720, [float("nan")] * 9, 1), (730, [float("inf")] * 9, 1), (740, heart[1].tolist(), None), (None, heart[1].tolist(), 1)]
    rows += [(750, [1.0, 2.0], 1), (760, [2.0, 1.0], 1), (761, [1.9, 1.0], 2), (770, [0.0] * 9, 1), (780, [], 3), (781, [], 3), (782, [], 2)]
    rows += [(790, heart[2].tolist(), 9), rows[10], rows[10]]  # a label of one row; repeated rows
    return rows


def test_against_brute_force(spark):
    rows = fixture()
    want = brute(rows)
    assert want and run(spark, rows) == want
    assert run(spark, rows, cell=8, piece=5) == want  # many cells, several rounds and pieces
    assert run(spark, rows, sample=3, cell=30) == want  # a poor index gives the same rows


def test_large_components_and_empty(spark):
    rows = [(i, [1e6 * (i % 5 - 1), 3e5 * i + 0.001, 7.25e6], i % 2) for i in range(30)]
    assert run(spark, rows) == brute(rows)
    rows = [(i, [1e300, 1.0], i % 2) for i in range(12)]
    assert {r[4] for r in run(spark, rows)} == {hn.TOP}
    assert run(spark, []) == []


def test_cells_come_by_falling_bound_and_bounds_hold():
    rnd = np.random.default_rng(2)
    x = np.floor(256 * rnd.normal(size=(300, 7)))
    book = hn.Book(tuple(hn.fit(h, 6) for h in hn.halves(x)))
    cells = []
    for half, (h, c) in enumerate(zip(hn.halves(x), book.centres)):
        own, far = hn.nearest(h, c)
        for j in range(len(c)):
            book.radii[half][j] = far[own == j].max(initial=0)
        cells.append(own)
    cell = cells[0] * len(book.centres[1]) + cells[1]
    book.pieces = dict.fromkeys(cell.tolist(), 1)
    visits = list(book.visits(x[0]))
    assert sorted(c for _, c in visits) == sorted(book.pieces) and all(a[0] >= b[0] for a, b in zip(visits, visits[1:]))
    bound = dict((c, b) for b, c in visits)
    assert all(x[0] @ v <= bound[c] for v, c in zip(x, cell))
