import random

from driftspark.llm import minhash
from driftspark.llm.common import connected_components

DOCS = "doc_id long, text string, component_id string, rep long"


def brute(rows):
    sets = [minhash.shingle_set(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            both = len(sets[a] & sets[b])
            if i is not None and j is not None and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), top(i) if i is not None else None, i is not None and top(i) == i) for (i, _), s in zip(rows, sets) if i is not None)


def fixture():
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("xyz") + str(rnd.randrange(40))
    base = [word() for _ in range(120)]
    rows = [(1000, " ".join(base))]
    # a graded group: copies with more and more edits, so that some reach the base only through others
    for i in range(60):
        w = list(base)
        for at in rnd.sample(range(0, 60), 1 + i // 6):
            w[at] = word()
        rows.append((2000 - i, " ".join(w)))
    rows += [(3000 + i, " ".join(base).upper().replace(" ", " \t\n")) for i in range(5)]  # the same words
    rows += [(4000 + i, "short text") for i in range(3)] + [(5000, ""), (5001, None), (5002, " \n"), (5003, "one two three four five")]
    passage = [word() for _ in range(30)]
    rows += [(6000 + i, " ".join([word() for _ in range(40)] + passage)) for i in range(30)]  # shared passages link nothing
    return rows


def test_against_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], DOCS).repartition(3)
    got = minhash.near_duplicates(df, block_docs=8).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, None)]
    got = minhash.near_duplicates(spark.createDataFrame([(i, t, None, None) for i, t in rows], DOCS)).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == [(3, 3, True), (3, 3, True), (9, 9, True), (None, None, False)]
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_deduplicated_keeps_columns_and_one_of_each(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows] + [(5003, "one two three four five", "x", 7), (None, "", "x", 7)], DOCS)
    out = minhash.deduplicated(df)
    assert out.columns == df.columns
    kept = {r[0] for r in brute(rows) if r[3]}
    got = [r.doc_id for r in out.collect()]
    assert sorted(x for x in got if x is not None) == sorted(kept) and got.count(None) == 1


def test_different_texts_of_one_id_are_kept(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (1, "a b c d e f g"), (2, "A b c d e f g"), (3, None), (3, ""), (None, "h i j k l m n"), (None, None), (4, "x y z"), (4, "x y z")]
    df = spark.createDataFrame([(i, t, f"c{k}", k) for k, (i, t) in enumerate(rows)], DOCS)
    key = lambda d: sorted(map(tuple, d.collect()), key=str)
    got = key(minhash.deduplicated(df))
    assert got == key(minhash.deduplicated(df.repartition(5)))
    texts = [((t or "").lower(), i is None) for i, t, _, _ in got]
    assert sorted(texts) == sorted([("a b c d e f g", False), ("h i j k l m n", False), ("", False), ("", False), ("h i j k l m n", True), ("", True), ("x y z", False)])
    same = spark.createDataFrame([(4, "x y z", f"c{k}", k) for k in range(3)] + [(5, "q", "c", 1)], DOCS)
    assert [(i, t) for i, t, _, _ in key(minhash.deduplicated(same))] == [(4, "x y z"), (5, "q")]
    assert minhash.deduplicated(df.where("false")).count() == 0


def test_long_text(spark):
    text = " ".join(f"w{i}" for i in range(30_000))
    got = minhash.near_duplicates(spark.createDataFrame([(1, text, "", 0), (2, text + " end", "", 0)], DOCS)).collect()
    assert {(r.n_shingles, r.component_id) for r in got} == {(29_996, 1), (29_997, 1)}


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_an_unrelated_repeated_id_changes_no_other_group(spark):
    text = lambda g: " ".join(f"w{g}x{j}" for j in range(20))
    rows = [(3 * g + k, text(g) + f" end{k}") for g in range(10) for k in range(3)]
    kept = lambda extra: {r.doc_id for r in minhash.deduplicated(spark.createDataFrame([(i, t, "", 0) for i, t in rows + extra], DOCS)).collect()}
    assert kept([]) == {3 * g for g in range(10)} == kept([(900, "one of two"), (900, "another text")]) - {900}
