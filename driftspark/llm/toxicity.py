"""Toxic passages by maximum-scoring segments over token log-odds, calibrated by extreme-value theory.

Training: document frequencies of words and word beginnings in toxic and clean labelled texts (equal texts count once, near copies mostly) give
log-odds with an informative Dirichlet prior, of which the lower confidence bound is a token's score; words without a
telling feature cost a little each. Scoring: a linear-time scan finds every maximal scoring segment of a text. The scores of the
significant ones are summed and turned into the probability that a clean text of that length has such a sum (Karlin and
Altschul's law, fitted on the clean training texts), and with the share of toxic texts into a score from 0 to 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import pieces, release_memory, save
from driftspark.llm.minhash import shingle_hashes

#: Labelled texts that the model learns from, by hash if there are more. This alone bounds the model, and so what is sent to the tasks.
MAX_TRAIN_DOCS = 200_000
PREFIXES = (4, 5, 6)
#: PRIOR: weight of the prior, as a share of the texts learned from.
PRIOR, MIN_DOCS, MIN_Z, MIN_SCORE = 0.05, 4, 3.5, 3.0
WORD_COST, ALPHA, THRESHOLD = 0.05, 0.05, 0.7

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


def doc_features(text: str | None) -> set[str]:
    return {f for w in set(words_of(text)) for f in features(w)}


@dataclass
class Model:
    scores: dict = field(default_factory=dict)
    prior: float = 0.1
    decay: float = 1.0
    k: float = 0.01

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """(place, score) of the telling words; a word has the score of its best feature."""
        got, out = self.scores, []
        if not got:
            return out
        known: dict = {}
        for i, w in enumerate(words):
            s = known.get(w)
            if s is None:
                known[w] = s = max((got.get(f, 0.0) for f in features(w)), default=0.0)
            if s:
                out.append((i, s))
        return out

    def expected(self, n: int, score: float) -> float:
        """Segments of at least this score that a clean text of n words has by chance."""
        return self.k * n * math.exp(-self.decay * score)

    def judge(self, text: str | None) -> tuple[float, list[tuple[int, int, float, float]]]:
        """The text's score and its significant segments: first and last word, score, expected number."""
        words = words_of(text)
        found = segments(self.hits(words))
        n = len(words)
        kept = [(i, j, s, self.expected(n, s)) for i, j, s in found]
        kept = [x for x in kept if x[3] < ALPHA]
        total = sum(x[2] for x in kept) or max((s for _, _, s in found), default=0.0)
        p = -math.expm1(-self.expected(n, total)) if total > 0 else 1.0
        return self.prior / (self.prior + (1 - self.prior) * p), kept


def segments(hits: list[tuple[int, float]], cost: float = WORD_COST) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last place, score), where places between the hits cost ``cost`` each: one pass, each
    hit is merged with earlier candidates as long as that raises them."""
    out: list[tuple[int, int, float, float]] = []  # first, last, total before it, total after it
    total, last = 0.0, None
    for at, s in hits:
        total -= cost * (at - last - 1) if last is not None else 0.0
        last = at
        cand = (at, at, total, total + s)
        total += s
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= cand[2]:
                j -= 1
            if j < 0 or out[j][3] >= cand[3]:
                out.append(cand)
                break
            cand = (out[j][0], cand[1], out[j][2], cand[3])
            del out[j:]
    return [(i, j, r - l) for i, j, l, r in out]


def _counts(df: DataFrame) -> DataFrame:
    """(feature, toxic, clean): in how many texts; counted up by task first."""

    def run(batches):
        toxic, clean = Counter(), Counter()
        for b in pieces(batches):
            for t, x in zip(b.column(0), b.column(1).to_pylist()):
                (toxic if x else clean).update(doc_features(t.as_py()))
            if len(toxic) + len(clean) > 100_000:
                yield of(toxic, clean)
                toxic, clean = Counter(), Counter()
        yield of(toxic, clean)
        del toxic, clean
        release_memory()

    def of(toxic, clean):
        names = list(toxic.keys() | clean.keys())
        return pa.record_batch([pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()), pa.array([clean[n] for n in names], pa.int64())], names=["feature", "toxic", "clean"])

    return df.select("text", "toxic").mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(toxic, clean, n_toxic: float, n_clean: float, prior: float = PRIOR):
    """Columns: the log-odds ratio with a Dirichlet prior spread like the feature's use overall, and its standard deviation."""
    a, a0 = prior * (toxic + clean), prior * (n_toxic + n_clean)
    d = F.log((toxic + a) / (n_toxic + a0 - toxic - a)) - F.log((clean + a) / (n_clean + a0 - clean - a))
    return d, F.sqrt(1 / (toxic + a) + 1 / (clean + a))


def _sketched(batches):
    """Adds the smallest shingle hash of each text, so that of a group of near copies few are learned from."""
    for b in pieces(batches):
        least = [int(h.view("int64").min()) if len(h := shingle_hashes(t.as_py().encode("utf-8", "surrogatepass").lower().split())) else 0 for t in b.column("text")]
        yield pa.record_batch([*b.columns, pa.array(least, pa.int64())], names=[*b.schema.names, "sketch"])
    release_memory()


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """A model from labelled texts: docs (doc_id, text), labels (doc_id, toxic). Labels that are null or of missing documents are
    ignored, several of a document count as toxic if one is; without labels of both kinds the model scores every text 0.1. Equal
    texts count once and, of texts with an equal sketch and label, that of the least doc_id; so reruns learn the same."""
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    hashed = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("h"))
    known = hashed.select("doc_id", "h").join(marks, "doc_id")
    chosen = known.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).orderBy("h").limit(max_docs)
    chosen = save(chosen, "toxic-train")  # at most max_docs short rows
    texts = hashed.join(F.broadcast(chosen), ["doc_id", "h"]).select("doc_id", "toxic", "text", "h")
    texts = save(texts.mapInArrow(_sketched, "doc_id long, toxic int, text string, h long, sketch long"), "toxic-sketches")
    first = texts.groupBy("toxic", "sketch").agg(F.min(F.struct("doc_id", "h")).alias("first")).select("first.*")
    texts = save(texts.join(F.broadcast(first), ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"]), "toxic-texts")  # what is dropped here is equal
    n_docs = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    if not n_docs.get(0) or not n_docs.get(1):
        return Model()
    n_toxic, n_clean = (float(n_docs[x]) * 1000 for x in (1, 0))  # as if each text had as many features
    d, sd = log_odds(F.col("toxic"), F.col("clean"), n_toxic, n_clean)
    scored = _counts(texts).where(F.col("toxic") >= MIN_DOCS).select("feature", d.alias("d"), sd.alias("sd"))
    scored = scored.where((F.col("d") / F.col("sd") >= MIN_Z) & (F.col("d") - 1.96 * F.col("sd") >= MIN_SCORE))
    kept = scored.select("feature", F.round(F.col("d") - 1.96 * F.col("sd"), 3)).collect()  # telling features of at most max_docs texts
    model = Model(scores=dict(sorted(map(tuple, kept))), prior=n_docs[1] / (n_docs[0] + n_docs[1]))
    if not model.scores:
        return model
    # the background: how often clean training texts have which score, and their best segments
    clean = texts.where("toxic = 0").select("text")

    def background(batches):
        seen, n, best = Counter(), 0, Counter()
        for b in pieces(batches):
            for t in b.column(0):
                w = words_of(t.as_py())
                h = model.hits(w)
                n += len(w)
                seen.update(round(s, 1) for _, s in h)
                best[round(max((s for _, _, s in segments(h)), default=0.0), 1)] += len(w)
        kinds, keys, counts = ["n"] + ["s"] * len(seen) + ["b"] * len(best), [0.0, *seen, *best], [n, *seen.values(), *best.values()]
        yield pa.record_batch([pa.array(kinds, pa.string()), pa.array(keys, pa.float64()), pa.array(counts, pa.int64())], names=["kind", "key", "count"])

    got = clean.mapInArrow(background, "kind string, key double, count long").groupBy("kind", "key").agg(F.sum("count").alias("count")).collect()
    words = max(1, next((r["count"] for r in got if r["kind"] == "n"), 1))
    seen = Counter({r["key"]: r["count"] for r in got if r["kind"] == "s"})
    top = round(max(model.scores.values()), 1)
    seen[top] += 0.5  # what was never seen is not impossible
    share = sum(seen.values()) / words

    def excess(x):
        return (1 - share) * math.exp(-x * WORD_COST) + sum(c / words * math.exp(x * s) for s, c in seen.items()) - 1

    lo, hi = 1e-4, 1e-4
    while excess(hi) < 0 and hi < 50:
        lo, hi = hi, hi * 1.5
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    model.decay = lo
    weighted = sum(r["count"] * math.exp(-model.decay * r["key"]) for r in got if r["kind"] == "b")
    model.k = max(n_docs[0] / max(weighted, 1e-9), model.decay * WORD_COST)
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, …) to one row per input row: doc_id, score, predicted, segments (first and last word, score, expected).

    Whole texts are read. Null and empty texts have no segments and the score of a text without hits. Rows stay as they are,
    repeated ones and null doc_ids too; other columns are ignored, an empty table gives no rows. No shuffle.
    """
    def run(batches):
        seg = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
        for b in pieces(batches):
            got = [model.judge(t.as_py()) for t in b.column(1)]
            segs = [[dict(zip(("first", "last", "score", "expected"), x)) for x in k] for _, k in got]
            yield pa.record_batch([b.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= threshold) for s, _ in got], pa.int32()), pa.array(segs, seg)], names=["doc_id", "score", "predicted", "segments"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int, segments array<struct<first:long,last:long,score:double,expected:double>>")


def held_out(doc_id):
    """Whether a document's label is kept from the model: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def not_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that the model doesn't reject."""
    columns = docs.columns
    at = columns.index("text")

    def run(batches):
        for b in pieces(batches):
            keep = pa.array([model.judge(t.as_py())[0] < threshold for t in b.column(at)], pa.bool_())
            yield b.filter(keep)
        release_memory()

    return docs.mapInArrow(run, docs.schema)
