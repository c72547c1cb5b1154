import math
import random
import zlib
from collections import Counter

from driftspark.llm import toxicity as tx

DOCS = "doc_id long, text string, score double"
LABELS = "doc_id long, toxic int, quality int"


def brute_segments(hits, cost):
    """All maximal segments by definition: the best segment, then the same left and right of it."""
    if not hits:
        return []
    best = None
    for i in range(len(hits)):
        s = 0.0
        for j in range(i, len(hits)):
            s += hits[j][1] - (cost * (hits[j][0] - hits[j - 1][0] - 1) if j > i else 0)
            if best is None or s > best[0] + 1e-9:
                best = (s, i, j)
    s, i, j = best
    return brute_segments(hits[:i], cost) + [(hits[i][0], hits[j][0], s)] + brute_segments(hits[j + 1 :], cost)


def test_segments_against_definition():
    rnd = random.Random(4)
    for _ in range(300):
        at, hits = 0, []
        for _ in range(rnd.randrange(12)):
            at += rnd.randrange(1, 60)
            hits.append((at, rnd.uniform(0.2, 4.0)))  # no ties
        got, want = tx.segments(hits, 0.1), brute_segments(hits, 0.1)
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in want]


def corpus(n=1500):
    rnd = random.Random(9)
    vocab = [f"{a}{b}{c}" for a in ("ba", "de", "ki", "lo") for b in ("ra", "mu", "ti", "so") for c in ("n", "st", "l", "", "ck")]
    rows, marks = [], []
    for i in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(20, 200))]
        bad = i % 6 == 0
        if bad:
            for _ in range(rnd.randrange(1, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(["vexil", "grobnak", "Grobnak,", "smurk"])
        rows.append((i, " ".join(w), 0.0))
        marks.append((i, int(bad), 1))
    return rows, marks


def test_held_out_accuracy_and_odd_rows(spark):
    rows, marks = corpus()
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, LABELS)
    model = tx.train(docs, labels.where(~tx.held_out("doc_id")))
    odd = [(None, None, 0.0), (5000, "", 0.0), (5001, "clean " * 30_000, 0.0), (5002, "vexil grobnak", 0.0), (5002, "vexil grobnak", 0.0)]
    got = {r.doc_id: r for r in tx.score(spark.createDataFrame(rows + odd, DOCS), model).collect()}
    test = [(x, got[i].predicted) for i, x, _ in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(x == p for x, p in test) >= 0.97 * len(test)
    assert got[None].predicted == got[5000].predicted == got[5001].predicted == 0 and got[5002].predicted == 1
    assert got[5000].score < got[5002].score <= 1 and got[5002].segments[0].last == 1
    kept = tx.not_toxic(spark.createDataFrame(rows + odd, DOCS), model)
    assert kept.columns == ["doc_id", "text", "score"] and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert tx.score(docs.where("false"), model).count() == 0


def test_labels_held_out_have_no_influence(spark):
    rows, marks = corpus(200)
    docs = spark.createDataFrame(rows, DOCS)
    other = [(i, 1 - x if zlib.crc32(str(i).encode()) % 3 == 1 else x, q) for i, x, q in marks]
    one, two = (tx.train(docs, spark.createDataFrame(m, LABELS).where(~tx.held_out("doc_id"))) for m in (marks, other))
    assert one == two


def brute_model(rows, marks):
    """The scores by plain counting."""
    first, texts = {}, {}
    for i, t, _ in rows:
        if i in marks and t is not None:
            first[t] = min(first.get(t, (i, 0))[0], i), max(first.get(t, (i, 0))[1], marks[i])
    for t, (i, x) in first.items():
        h = tx.shingle_hashes(t.encode().lower().split())
        key = (x, int(h.view("int64").min()) if len(h) else 0)
        texts[key] = min(texts.get(key, (i, t)), (i, t))
    got = Counter((x, f) for (x, _), (_, t) in texts.items() for f in tx.doc_features(t))
    n = [sum(x == y for x, _ in texts) * 1000.0 for y in (0, 1)]
    scores = {}
    for f in {f for _, f in got}:
        t, c = got[1, f], got[0, f]
        a, a0 = tx.PRIOR * (t + c), tx.PRIOR * (n[0] + n[1])
        d = math.log((t + a) / (n[1] + a0 - t - a)) - math.log((c + a) / (n[0] + a0 - c - a))
        sd = math.sqrt(1 / (t + a) + 1 / (c + a))
        if t >= tx.MIN_DOCS and d / sd >= tx.MIN_Z and d - 1.96 * sd >= tx.MIN_SCORE:
            scores[f] = round(d - 1.96 * sd, 3)
    return scores, n[1] / (n[0] + n[1]), [t for (x, _), (_, t) in texts.items() if not x]


def brute_score(text, model):
    """The score from the segments by definition and the law's two numbers."""
    words = tx.words_of(text)
    hits = [(i, s) for i, w in enumerate(words) if (s := max((model.scores.get(f, 0.0) for f in tx.features(w)), default=0.0))]
    found = [s for _, _, s in brute_segments(hits, tx.WORD_COST)]
    e = lambda s: model.k * len(words) * math.exp(-model.decay * s)
    total = sum(s for s in found if e(s) < tx.ALPHA) or max(found, default=0.0)
    p = 1 - math.exp(-e(total)) if total > 0 else 1.0
    return model.prior / (model.prior + (1 - model.prior) * p)


def test_model_and_scores_against_brute_force(spark):
    rows, marks = corpus(900)
    rows = [(i, t + f" word{i % 7}s", z) for i, t, z in rows] + [(2000, rows[0][1], 0.0), (2000, None, 0.0), (2000, "other", 0.0)]
    marks += [(2000, 1, 0), (0, 0, 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    model = tx.train(docs, spark.createDataFrame(marks, LABELS))
    flags = {}
    for i, x, _ in marks:
        flags[i] = max(x, flags.get(i, 0))
    scores, prior, clean = brute_model(rows, flags)
    assert model.scores == scores and scores and abs(model.prior - prior) < 1e-12
    # the law: clean texts' best segments have the expected number one on the whole, and a random word's score adds up to one
    best = [max((s for _, _, s in tx.segments(model.hits(tx.words_of(t)))), default=0.0) for t in clean]
    assert abs(model.k * sum(len(tx.words_of(t)) * math.exp(-model.decay * round(s, 1)) for t, s in zip(clean, best)) - len(clean)) < 1e-6 * len(clean) or model.k == model.decay * tx.WORD_COST
    got = tx.score(docs, model).collect()
    want = Counter((i, round(brute_score(t, model), 6)) for i, t, _ in rows)
    assert Counter((r.doc_id, round(r.score, 6)) for r in got) == want
    assert all(r.predicted == (r.score >= tx.THRESHOLD) for r in got)
    assert tx.train(docs.repartition(2), spark.createDataFrame(marks, LABELS)) == model


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b", 0.0)], DOCS)
    model = tx.train(docs, spark.createDataFrame([(1, None, 1), (2, 1, 1)], LABELS))
    assert [r.predicted for r in tx.score(docs, model).collect()] == [0]
