import numpy as np

from driftspark.llm import embed_dedup as ed

VECS = "vec_id long, embedding array<float>, label int, e string"


def brute(rows, threshold):
    unit = {}
    for i, (v, e, lab) in enumerate(rows):
        ok = lab is not None and e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e) and len(e) > 0
        unit[i] = np.array(e, np.float32).astype(float) / np.linalg.norm(np.array(e, np.float32).astype(float)) if ok else None
    n = len(rows)
    link = [[unit[i] is not None and unit[j] is not None and i != j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold for j in range(n)] for i in range(n)]
    comp = {i: rows[i][0] for i in range(n)}
    for _ in range(n):
        new = {i: min([comp[i]] + [comp[j] for j in range(n) if link[i][j]]) for i in range(n)}
        if new == comp:
            break
        comp = new
    return sorted((rows[i][0], sum(link[i]), comp[i], comp[i] == rows[i][0]) for i in range(n))


def fixture():
    rnd = np.random.default_rng(3)
    rows = []
    for i in range(150):
        rows.append([i, rnd.normal(size=16).tolist(), int(i % 3)])
    centre = rnd.normal(size=16)
    for i in range(60):  # a drifting chain of near copies
        rows.append([200 + i, (centre + 0.02 * i * np.roll(centre, 3) + 0.03 * rnd.normal(size=16)).tolist(), 1])
    rows += [[300 + i, rows[5][1], 2] for i in range(4)]  # equal vectors
    rows += [[400, None, 1], [401, [0.0] * 16, 1], [402, [float("nan")] * 16, 1], [403, [None] * 16, 1], [404, rows[5][1], None], [405, [], 1], [406, [1.0, 2.0], 1], [407, [2.0, 4.0], 1]]
    return [tuple(r) for r in rows]


def test_against_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(v, e, lab, "x") for v, e, lab in rows], VECS).repartition(3)
    for how in ({}, {"shard": 20, "shard_max": 15}):
        got = ed.near_vectors(df, **how)
        assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()) == brute(rows, 0.93)
    audit = ed.audit_recall(df, got, every=10).collect()
    assert audit and all(r.there == r.found for r in audit if r.vec_id < 400)


def test_null_ids_and_empty(spark):
    e = [1.0, 2.0]
    got = ed.near_vectors(spark.createDataFrame([(None, e, 1, ""), (4, e, 1, ""), (4, e, 1, "")], VECS)).collect()
    assert sorted(((r.vec_id, r.component_id, r.kept) for r in got), key=str) == [(4, 4, True), (4, 4, True), (None, None, False)]
    assert ed.near_vectors(spark.createDataFrame([], VECS)).count() == 0


def test_prune_keeps_the_nearest_and_spreads():
    x = np.eye(4)[[0, 0, 1, 2]] + 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert ed.robust_prune(np.array([1, 2, 3]), x[[1, 2, 3]] @ x[0], x[[1, 2, 3]] @ x[[1, 2, 3]].T, 8, 1.2)[0] == 1


def test_links_count_at_both_ends_whatever_the_number_of_shards(spark):
    rnd = np.random.default_rng(8)
    rows = [(i, rnd.normal(size=6).tolist(), 1) for i in range(2500)]
    unit = np.array([e for _, e, _ in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    there = int((unit @ unit.T >= 0.93).sum()) - len(rows)
    df = spark.createDataFrame([(v, e, lab, "x") for v, e, lab in rows], VECS).repartition(3)
    got = ed.near_vectors(df, shard=12).collect()
    assert sum(r.n_links for r in got) >= 0.93 * there
    size = {}
    for r in got:
        size[r.component_id] = size.get(r.component_id, 0) + 1
    assert all((r.n_links > 0) == (size[r.component_id] > 1) for r in got)
