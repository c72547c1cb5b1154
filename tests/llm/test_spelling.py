import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from driftspark.llm import spelling as sp

DOCS = "doc_id long, text string, word string, n int"


def counted(rows):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if i is not None and (h := zlib.crc32(f"{i}:{w}".encode())) % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(rows):
    n = counted(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def fixture(seed=1):
    rnd = random.Random(seed)
    letters = "abcdeéßØzq"
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(4, 9))) for _ in range(150)]
    for w in words[:60]:
        for _ in range(3):
            k = rnd.randrange(len(w))
            words.append(rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice(letters) + w[k:], w[:k] + rnd.choice(letters) + w[k + 1 :]]))
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "abababa", "ABABABAB"]
    rows = [(i, " ".join(rnd.choice(words[: 1 + rnd.randrange(len(words))]) for _ in range(300)).title() + rnd.choice([".", "×y", "--", "9"])) for i in range(60)]
    return rows + [(None, " ".join(words[:40])), (70, None), (71, ""), (72, "1 2 3"), (73, " ".join(words)), (73, " ".join(words))]


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_against_brute_force(spark):
    rows = fixture()
    got = rows_of(sp.spelling_variants(spark.createDataFrame([(i, t, "w", 1) for i, t in rows], DOCS).repartition(3)))
    want = brute(rows)
    assert got == want and any(r[2] not in (r[0], r[1]) for r in want) and sum(r[4] for r in want) > 300


def test_the_given_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert rows_of(sp.spelling_variants(docs)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_empty_long_and_wordless(spark):
    assert sp.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
    assert sp.spelling_variants(spark.createDataFrame([(1, None, "", 0), (2, "to be or not", "", 0)], DOCS)).count() == 0
    big = "x" * 200_000
    rows = [(i, f"{big} {big[:-1]}y " * 2 + "plain " * 100_000) for i in range(2)]
    got = rows_of(sp.spelling_variants(spark.createDataFrame([(i, t, "", 0) for i, t in rows], DOCS)))
    assert got == brute(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abcé", min_size=5, max_size=9), min_size=2, max_size=30, unique=True))
def test_pivots_lose_no_near_word(words):
    counts = Counter(g for w in words for g in set(sp.bigrams(w)))
    order = {g: k for k, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}
    index = {}
    for w in words:
        places, last = sp.prefix_of(w, order)
        pivots = sp.pivots_of(w, places, order)
        assert len(pivots) == 2 and pivots[1] - pivots[0] >= 2
        weight = lambda p: sum(order[w[i : i + 2]] for i in p)  # noqa: E731, B023
        assert weight(pivots) == min(weight((i, j)) for i in places for j in places if j - i >= 2)
        index[w] = sp.keys_of(w, order)
    found = lambda a, b: any(x[:2] == y[:2] and x[3] and x[2] <= y[2] for x in index[a] for y in index[b])
    assert all(found(a, b) or found(b, a) for a in words for b in words if one_edit(a, b))


def test_lengths_around_the_bound_of_long_words(spark):
    rnd = random.Random(5)
    words = []
    for size in range(sp.LONG - 2, sp.LONG + 4):
        w = "".join(rnd.choice("abcd") for _ in range(size))
        words += [w, w[:-1], "q" + w, w[:7] + "z" + w[8:], w[: size // 2] + w[size // 2 + 1 :]]
    rows = [(1, " ".join(words * 3))]
    assert rows_of(sp.spelling_variants(spark.createDataFrame([(i, t, "", 0) for i, t in rows], DOCS))) == brute(rows)
