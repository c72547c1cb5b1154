import random
import time

from pyspark.sql import functions as F

from driftspark.llm import decontam

BENCH = "item_id long, text string, words int"
DOCS = "doc_id long, text string, item_id string"
ITEM = "A train leaves the old station with 120 passengers and travels 45 km to the town of Marlow before the evening comes"


def found(spark, docs, bench=((1, ITEM),), **how):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 0) for i, t in bench], BENCH)
    return sorted(((r.doc_id, r.item_id, r.verbatim) for r in decontam.contaminated(d, b, **how).collect()), key=str)


def test_verbatim_changed_and_clean(spark):
    docs = [
        (1, "Some words before it. " + ITEM + ". And after."),
        (2, "so " + ITEM.replace("120", "87").replace("45 km", "30 miles").replace("Marlow", "Derby").upper().lower().replace("derby", "Derby")),
        (3, "A train leaves the old station and nothing else here is the same as in the item at all, not one bit of it"),
        (4, None), (5, ""), (6, "train"), (7, ITEM.replace(" ", "\n\t")),
    ]
    assert found(spark, docs) == [(1, 1, True), (2, 1, False), (7, 1, True)]


def test_slots_must_be_consistent(spark):
    item = "Take 5 apples and 5 pears and 7 plums"
    how = dict(coverage=0.9, least_words=5)
    assert found(spark, [(1, "Take 9 apples and 9 pears and 2 plums")], [(1, item)], **how) == [(1, 1, False)]
    assert found(spark, [(1, "Take 9 apples and 8 pears and 2 plums")], [(1, item)], **how) == []


def test_short_items_shuffled_windows_and_repeats(spark):
    docs = [(1, "well then what is the capital of it today"), (1, "well then what is the capital of it today"), (None, "xx " + ITEM), (2, "what is the")]
    bench = [(7, "what is the capital"), (8, ITEM), (8, ITEM), (9, None), (10, "")]
    assert found(spark, docs, bench, broadcast_windows=0) == found(spark, docs, bench)
    assert sorted(map(str, found(spark, docs, bench))) == ["(1, 7, True)", "(None, 8, True)"]


def test_every_offset_against_brute_force(spark):
    words = [f"w{i}" for i in range(40)]
    item = " ".join(words[5:25])
    docs = [(i, " ".join([f"x{i}_{k}" for k in range(i)] + words[5 + i : 25])) for i in range(20)]
    want = sorted((i, 1, True) for i in range(20) if 20 - i >= 10 and (20 - i) / 20 >= 0.5 and 20 - i >= 11)
    got = found(spark, docs, [(1, item)])
    assert set(want) <= set(got) and all(20 - i >= 10 for i, _, _ in got)


def test_empty_tables_and_filter(spark):
    assert found(spark, [], [(1, ITEM)]) == [] and found(spark, [(1, ITEM)], []) == []
    d = spark.createDataFrame([(1, ITEM, "a"), (2, "clean", "b"), (None, None, "c")], DOCS)
    out = decontam.decontaminated(d, spark.createDataFrame([(1, ITEM, 0)], BENCH))
    assert out.columns == d.columns and sorted(map(str, (r.doc_id for r in out.collect()))) == ["2", "None"]


def test_several_variants_in_one_document(spark):
    item, two = "What is the sum of 5 and 7?", "What is the sum of 3 and 4?"
    docs = [(1, f"{item} {two}"), (2, f"{two} {item}"), (3, f"{two} What is the sum of 9 and 1?"), (4, "What is the sum of 3 and or so")]
    assert found(spark, docs, [(1, item)]) == [(1, 1, True), (2, 1, True), (3, 1, False)]
    shop = "Take 5 apples, 3 pears, 2 plums, 9 figs, 4 limes now"
    other = "Take 1 apples, 8 pears, 6 plums, 7 figs, 2 limes now"
    wrong = "Take 1 apples, 1 pears, 1 plums, 1 figs, 1 limes now"  # no one-to-one map: 7 of 12 words
    assert found(spark, [(1, f"{other}. {shop}"), (2, f"{wrong}. {wrong}"), (3, f"{wrong}. {other}")], [(1, shop)]) == [(1, 1, True), (3, 1, False)]
    # a word put in: the two offsets agree and are taken together
    assert found(spark, [(1, ITEM.replace("and travels", "and then travels").replace("120", "87"))], coverage=0.9) == [(1, 1, False)]


def test_stray_marks_and_units_lose_no_slots(spark):
    item = "What is the sum of 5 and 7?"
    docs = [(i, f"{stray}. {item}") for i, stray in enumerate(("see §5 there", "§ 12 § and §Bob", "after v2 days", "an A4 h", "a 5 km B2 m 1,000 ft, Bob", "3§ km", "§n45§ §ukm §pBob"))]
    assert found(spark, docs, [(1, item)]) == [(i, 1, True) for i in range(len(docs))]
    assert found(spark, [(1, "§7 v2 days. What is the sum of 1 and 3?")], [(1, item)]) == [(1, 1, False)]


def test_one_value_for_each_slot(spark):
    texts = ["It took 1,000.5 km and 12:30 h to Bob, Ann §5 x §n §", "v2 days A4 h 5 km 7 7/8 9. m, İx and İx 3kg ½ g", ITEM, "", None]
    d = spark.createDataFrame([(t,) for t in texts], "text string").select(decontam.tokens(F.col("text")).alias("t"))
    rows = d.select(decontam.template(d.t).alias("words"), decontam.values(d.t).alias("values")).collect()
    assert all(sum(w.startswith("§") for w in r.words) == len(r["values"]) for r in rows)
    assert rows[0].words == "it took §n §u and §n §u to §p §p §n x n".split() and rows[0]["values"] == ["1,000.5", "km", "12:30", "h", "bob", "ann", "5"]


def test_texts_and_items_of_numbers(spark):
    """Any list of numbers fits a list of numbers, so the values must agree there; in sentences the template is enough."""
    rng = random.Random(8)
    numbers = [str(rng.randrange(10_000, 99_999)) for _ in range(100_000)]
    listed, asked = " ".join(numbers[500:560]), "Add 12 34 56 to the first heap of stones and then tell me how many there are"
    docs = [(1, " ".join(numbers)), (2, " ".join(reversed(numbers))), (3, "so " + asked.replace("34", "99") + " " + " ".join(numbers[:50_000]))]
    began = time.time()
    assert found(spark, docs, [(1, listed), (2, asked)]) == [(1, 1, True), (3, 1, True), (3, 2, False)]
    assert time.time() - began < 60


def test_runs_of_ten_words_at_every_place(spark):
    words = [f"w{i}" for i in range(20)]
    docs = [(10 * k + i, " ".join([f"x{j}" for j in range(k)] + words[i : i + 10] + ["y"])) for k in range(5) for i in (0, 3, 10)]
    assert found(spark, docs, [(1, " ".join(words))]) == sorted(((i, 1, True) for i, _ in docs), key=str)


def test_every_agreeing_offset_against_brute_force(spark):
    rng, bench, docs, want = random.Random(5), [], [], []
    for n in (1, 2, 5, 10, 11, 12, 14, 15, 17, 20, 24, 40):
        item = [f"{'abcde'[rng.randrange(5)]}{rng.randrange(8)}q" for _ in range(n)]
        bench.append((n, " ".join(item)))
        for k in range(8):  # at random places, evenly spread, or in the middle only, words are changed
            least = max(-(-n // 2), min(10, n))
            bad = {0: set(range(1, n, 2)), 1: {n // 2}}.get(k, set(rng.sample(range(n), min(n, max(0, n - least + rng.randrange(2))))))
            doc = [f"z{rng.random()}".replace(".", "x") for _ in range(rng.randrange(7))] + [f"other{j}" if j in bad else w for j, w in enumerate(item)]
            docs.append((1000 * k + n, " ".join(doc)))
    for i, text in docs:
        d = text.split()
        for n, t in bench:
            item = t.split()
            best = max(sum(0 <= o + j < len(d) and d[o + j] == w for j, w in enumerate(item)) for o in range(-n, len(d)))
            if best >= max(n / 2, min(10, n)):
                want.append((i, n, True))
    got = found(spark, docs, bench)
    assert sorted(set(want), key=str) == sorted(set(got), key=str) and len(want) > 50
    assert found(spark, docs, bench, broadcast_windows=0) == got


def test_slots_against_brute_force(spark):
    """Finds, false finds and the verbatim flag, for items with numbers whose values are kept, renamed, or put in at random."""
    rng, items, docs = random.Random(11), {}, {}
    for n in (11, 12, 16, 21, 30):
        items[n] = [str(rng.choice((5, 7, 9))) if j % 3 == 1 else f"{'abcde'[rng.randrange(5)]}{'fghij'[rng.randrange(5)]}{n}w" for j in range(n)]
    for n, item in items.items():
        for k in range(24):
            named = dict(zip("579", rng.sample(("5", "7", "9", "11", "13"), 3)))
            value = (lambda w: w, named.get, lambda w: str(rng.choice((5, 7, 9, 11))))[k % 3]
            bad = set(rng.sample(range(n), rng.randrange(n // 2 + 2)))
            words = [f"x{rng.randrange(10**6)}y" if j in bad else value(w) if w.isdigit() else w for j, w in enumerate(item)]
            docs[100 * k + n] = [f"q{rng.randrange(10**6)}y" for _ in range(rng.randrange(5))] + words

    def best(item, doc):
        n, out = len(item), (0, False)
        for o in range(1 - n, len(doc)):
            met = [(w, doc[o + j]) for j, w in enumerate(item) if 0 <= o + j < len(doc) and (w == doc[o + j] or w.isdigit() and doc[o + j].isdigit())]
            slots = {(a, b) for a, b in met if a.isdigit()}
            one = len(slots) == len({a for a, _ in slots}) == len({b for _, b in slots})
            if len(met) >= 8:
                out = max(out, (sum(one or not a.isdigit() for a, _ in met), all(a == b for a, b in slots)))
        return out

    want = []
    for i, doc in docs.items():
        for n, item in items.items():
            matched, verbatim = best(item, doc)
            if matched >= max(n / 2, min(10, n)):
                want.append((i, n, verbatim))
    got = found(spark, [(i, " ".join(d)) for i, d in docs.items()], [(n, " ".join(t)) for n, t in items.items()])
    assert got == sorted(want, key=str) and {v for _, _, v in got} == {True, False} and len(docs) // 3 < len(got) < len(docs)
