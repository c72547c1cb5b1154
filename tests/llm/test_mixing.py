from collections import defaultdict

from driftspark.llm import mixing

DOCS = "doc_id long, text string, source string, size string, class int"


def test_targets_by_repeated_sharing(spark):
    sizes = {"a": 100, "b": 5000, "c": 10, "d": 0, None: 700}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names = ["a", "b", "c", "d", None]
    weight = dict(zip(names, (3, 1, 2, 3, 1)))
    target, open_, left = {n: 0.0 for n in names}, set(names), 1.5 * sum(sizes.values())
    while left > 1e-9 and open_:
        total, over = sum(weight[n] for n in open_), 0.0
        for n in sorted(open_, key=str):
            target[n] += left * weight[n] / total
        for n in list(open_):
            if target[n] >= 2 * sizes[n]:
                over += target[n] - 2 * sizes[n]
                target[n] = 2.0 * sizes[n]
                open_.remove(n)
        left = over
    assert all(abs(got[n] - target[n]) < 1e-6 for n in names)


def test_taken_words(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 200)) if i % 50 else None, f"s{i % 4}" if i % 9 else None, "x", i) for i in range(2000)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    assert len(got) == 2000 and got[0].doc.asDict().keys() == {"doc_id", "text", "source", "size", "class"}
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.size == (len(r.doc.text.split()) if r.doc.text else 0)
        taken[r.doc.source] += r.taken
        size[r.doc.source] += r.size
        target[r.doc.source] = (r.target, r.source_size)
    assert all(target[s][1] == size[s] and abs(taken[s] - target[s][0]) <= 0.02 * target[s][0] + 400 for s in taken)
    again = {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    assert mixing.mixed(df).count() == sum(r.copies for r in got) and mixing.mixed(df).columns == df.columns


def test_systematic_counts(spark):
    """Copies of a source lie between the floor and the ceiling of its rate, and add up to the rate times its documents."""
    df = spark.createDataFrame([(i, "a b c", "one" if i % 3 else "two", "", 0) for i in range(900)], DOCS)
    by = defaultdict(list)
    for r in mixing.mix(df).collect():
        by[r.doc.source].append((r.copies, r.target / r.source_size))
    for rows in by.values():
        rate = rows[0][1]
        assert all(c in (int(rate), int(rate) + 1) or abs(rate - round(rate)) < 1e-9 and c == round(rate) for c, _ in rows)
        assert abs(sum(c for c, _ in rows) - rate * len(rows)) <= 1


def test_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None, "", 0), (1, "", None, "", 0), (None, " ", "x", "", 0)], DOCS)).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 3
