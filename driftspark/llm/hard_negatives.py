"""Hard negatives by an inverted multi-index: exact best scores of each anchor inside windows, without looking at every row.

1. Components become integers. Rows of equal vector and label are one group with its smallest ids, as many as any answer can hold
   (ties go by id, so further copies are in no answer).
2. Each half of the vectors' space has a codebook, fitted on a bounded sample; every row is indexed. A row's cell is the pair of its
   nearest centres. A cell's rows lie in pieces of bounded size. For each centre the index knows the radius of its rows.
3. A row's score with an anchor is at most the sum, over both halves, of the anchor's product with the centre and of its length times
   the radius. The multi-sequence heap gives an anchor its cells by falling bound. Anchors visit theirs in rounds, the next 8 cells,
   then 64, then 512; between rounds, what was found raises each window's lower end. An anchor stops when the next cell's bound is
   below all its windows: they are certified, no unseen row can enter.
4. The first pass has one open window over rows of the anchor's label (positives), the second one window for each positive over rows
   of other labels.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspark.llm.common import Saved, release_memory, save

#: Rows the codebooks are fitted on, rows of a cell about, centres of a half at most, rows of a piece.
SAMPLE, CELL, MAX_CENTRES, PIECE = 20_000, 256, 256, 512
#: Anchors that one request carries; cells of the first round, and how much longer each round is than the one before.
BLOCK, STEP, GROWTH = 64, 8, 8
TOP, BOTTOM = 2**63 - 1, 1 - 2**63


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label int, v): the rows that take part, with floor(scale * x) for each component, as whole doubles."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.transform(x, lambda c: c * scale).alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # rounding down on doubles: floor() would give a long and overflow
    down = lambda c: F.when(F.abs(c) < 2.0**52, F.floor(c).cast("double")).otherwise(c) + F.lit(0.0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fine).select("vec_id", "label", F.transform("x", down).alias("v"))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: in doubles where every partial sum is below 2 ** 53, else in Python's integers, held to
    what a long holds."""
    if q.shape[1] == 0 or np.sqrt((q * q).sum(axis=1).max(initial=0)) * np.sqrt((x * x).sum(axis=1).max(initial=0)) < 2.0**52:
        return (q @ x.T).astype(np.int64)
    whole = lambda a: np.array([[int(c) for c in r] for r in a], dtype=object)
    return np.array([[max(BOTTOM, min(TOP, int(s))) for s in r] for r in whole(q) @ whole(x).T], dtype=np.int64)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (x.shape[1] + 1) // 2
    return x[:, :cut], x[:, cut:]


def fit(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k centres by k-means, begun at rows spread over the sample."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, c)[0]
        for j in range(len(c)):
            if len(part := x[own == j]):
                c[j] = part.mean(axis=0)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centre and the distance to it."""
    own = np.argmax(x @ c.T - (c * c).sum(axis=1) / 2, axis=1)
    return own, np.sqrt(((x - c[own]) ** 2).sum(axis=1))


class Book:
    """The codebooks of the vectors of one length: centres, radii and the pieces of each cell that has rows."""

    def __init__(self, centres: tuple[np.ndarray, np.ndarray]):
        self.centres, self.radii, self.pieces = centres, tuple(np.zeros(len(c)) for c in centres), {}

    def bounds(self, v: np.ndarray) -> list[np.ndarray]:
        """For each half and centre: no row of that centre has a larger half-score with v."""
        out = []
        for half, c, r in zip(halves(v[None]), self.centres, self.radii):
            b = c @ half[0] + math.sqrt(float(half[0] @ half[0])) * r
            out.append(b + 1e-9 * np.abs(b) + 0.25)  # for rounding; scores are whole numbers
        return out

    def visits(self, v: np.ndarray):
        """(bound, cell) of the cells that have rows, by falling bound: a heap over both halves' sorted bounds, each pair opening the next
        of its row and, in the first column, the next row."""
        one, two = self.bounds(v)
        a, b = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
        heap = [(-(one[a[0]] + two[b[0]]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            if (cell := int(a[i]) * len(two) + int(b[j])) in self.pieces:
                yield -bound, cell
            if j + 1 < len(b):
                heapq.heappush(heap, (-(one[a[i]] + two[b[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(one[a[i + 1]] + two[b[0]]), i + 1, 0))


class MultiIndex:
    """rows (label int, v array<double>, ids array<long> ascending) by cell and piece, and a book for each length of vectors."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, cell: int = CELL, piece: int = PIECE):
        sizes = {r["dims"]: r["n"] for r in rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).collect()}  # a row a length
        total = max(1, sum(sizes.values()))
        part = rows.select("v", F.pmod(F.xxhash64("v", F.lit(5)), F.lit(1 << 20)).alias("h")).where(F.col("h") <= (1 << 20) * min(1.0, 1.2 * sample / total))
        fitted = part.orderBy("h").limit(sample).toPandas()["v"]
        self.books: dict[int, Book] = {}
        for dims, n in sizes.items():
            own = [v for v in fitted if len(v) == dims]
            x = np.array(own, dtype=float).reshape(len(own), dims)
            k = max(1, min(MAX_CENTRES, math.ceil(math.sqrt(n / cell))))
            self.books[dims] = Book(tuple(fit(h, k) if len(x) and h.shape[1] else np.zeros((1, h.shape[1])) for h in halves(x)))
        books = self.books

        def assign(batches):
            for b in batches:
                b["dims"] = [len(v) for v in b["v"]]
                for dims, g in b.groupby("dims"):
                    x, out = np.stack(g["v"].to_numpy()) if dims else np.zeros((len(g), 0)), g.copy()
                    (out["one"], out["d1"]), (out["two"], out["d2"]) = (nearest(h, c) for h, c in zip(halves(x), books[dims].centres))
                    yield out

        placed = rows.select("label", "v", "ids").mapInPandas(assign, "label int, v array<double>, ids array<long>, dims int, one int, d1 double, two int, d2 double")
        placed = Saved(placed, "multi-index-places")
        for half, column, far in ((0, "one", "d1"), (1, "two", "d2")):
            for r in placed.df.groupBy("dims", column).agg(F.max(far).alias("r")).collect():  # MAX_CENTRES rows a length at most
                books[r["dims"]].radii[half][r[column]] = r["r"] * (1 + 1e-9)
        cells = placed.df.groupBy("dims", "one", "two").agg(F.count("*").alias("n"))
        wide = F.create_map(*(F.lit(z) for d, b in books.items() for z in (d, len(b.centres[1])))) if books else F.lit(None).cast("map<int,int>")
        counts = save(cells.select("dims", "one", "two", F.ceil(F.col("n") / piece).alias("pieces")), "multi-index-cells")
        for r in counts.collect():  # at most MAX_CENTRES ** 2 rows a length
            books[r["dims"]].pieces[r["one"] * len(books[r["dims"]].centres[1]) + r["two"]] = r["pieces"]
        at = placed.df.join(counts, ["dims", "one", "two"]).select("dims", (F.col("one") * wide[F.col("dims")] + F.col("two")).cast("int").alias("cell"), F.pmod(F.xxhash64("v", "label"), "pieces").cast("int").alias("piece"), "label", "v", "ids")
        packed = at.groupBy("dims", "cell", "piece").agg(F.collect_list(F.struct("label", "v", "ids")).alias("rows"))  # some PIECE rows
        self.packed = save(packed, "multi-index")
        placed.drop()

    def search(self, asked: DataFrame, k: int, same_label: bool, block: int = BLOCK, step: int = STEP, growth: int = GROWTH) -> DataFrame:
        """asked (akey long, vec_id long, label int, v, windows array<struct<w int, hi long, lo long>>) to (akey, w, vec_id, score): for each window
        the first k rows, by falling score and then by id, with lo <= score <= hi and of the same label as asked, or of another."""
        found = Saved(asked.sparkSession.createDataFrame([], "akey long, w int, vec_id long, score long"), "found")
        seen = 0
        while True:
            requests = Saved(self._requests(asked, found.df, k, seen, step, block), "requests")
            if requests.df.isEmpty():
                requests.drop()
                return found.df
            hits = requests.df.join(self.packed, ["dims", "cell", "piece"]).select("akeys", "ids", "labels", "v", "windows", "rows").mapInArrow(_best(k, same_label), "akey long, w int, vec_id long, score long")
            order = Window.partitionBy("akey", "w").orderBy(F.desc("score"), "vec_id")
            new = Saved(found.df.union(hits).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r"), "found")
            requests.drop()
            found.drop()
            found, seen, step = new, seen + step, step * growth

    def _requests(self, asked: DataFrame, found: DataFrame, k: int, seen: int, step: int, block: int) -> DataFrame:
        """The next ``step`` cells of each anchor after the ``seen`` first, as far as a window is open there: one row for a piece and a block."""
        books = self.books
        full = found.groupBy("akey", "w").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        full = full.groupBy("akey").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("least"))  # k windows at most
        raised = F.transform("windows", lambda s: F.struct(s["w"].alias("w"), s["hi"].alias("hi"), F.greatest(s["lo"], F.coalesce(F.element_at("least", s["w"]), s["lo"])).alias("lo")))
        now = asked.join(full, "akey", "left").select("akey", "vec_id", "label", "v", raised.alias("windows")).where(F.size("windows") > 0)

        def run(batches):
            for b in batches:
                for at in range(0, len(b), block):
                    rows, wanted = b.iloc[at : at + block], {}
                    for place, (v, windows) in enumerate(zip(rows["v"], rows["windows"])):
                        book = books.get(len(v))
                        low = min(w["lo"] for w in windows)
                        for n, (bound, cell) in enumerate(book.visits(np.array(v, dtype=float)) if book else ()):
                            if n >= seen + step or bound < low:
                                break
                            if n >= seen:
                                wanted.setdefault((len(v), cell), []).append(place)
                    out = []
                    for (dims, cell), places in wanted.items():
                        r = rows.iloc[places]
                        same = [dims, cell, r["akey"].tolist(), r["vec_id"].tolist(), r["label"].tolist(), r["v"].tolist(), r["windows"].tolist()]
                        out += [[*same, p] for p in range(books[dims].pieces[cell])]
                    if out:
                        yield pd.DataFrame(out, columns=["dims", "cell", "akeys", "ids", "labels", "v", "windows", "piece"])

        return now.mapInPandas(run, "dims int, cell int, akeys array<long>, ids array<long>, labels array<int>, v array<array<double>>, windows array<array<struct<w int, hi long, lo long>>>, piece int")


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), dims)


def _best(k: int, same_label: bool):
    """The best k rows of a piece for each window of each anchor of a request."""

    def run(batches):
        for b in batches:
            out = []
            for at in range(b.num_rows):
                akeys, ids, labels, asked, windows = (b.column(c)[at].as_py() for c in ("akeys", "ids", "labels", "v", "windows"))
                rows = b.column("rows")[at].values
                dims = len(asked[0])
                scores = products(np.array(asked, dtype=float).reshape(len(asked), dims), _matrix(rows.field("v"), dims))
                of, groups = rows.field("label").to_numpy(), rows.field("ids")
                for akey, own, label, some, s in zip(akeys, ids, labels, windows, scores):
                    open_ = np.flatnonzero(((of == label) == same_label) & (s >= min(w["lo"] for w in some)))
                    for w in some:
                        fits = open_[(s[open_] <= w["hi"]) & (s[open_] >= w["lo"])]
                        if len(fits) > k + 1:  # one group may be the anchor alone
                            fits = fits[s[fits] >= np.partition(s[fits], -k - 1)[-k - 1]]
                        best = sorted((-int(s[g]), i) for g in fits for i in groups[int(g)].as_py() if not (same_label and i == own))
                        out += [(akey, w["w"], i, -x) for x, i in best[:k]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))] if out else [pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())], names=["akey", "w", "vec_id", "score"])
        release_memory()

    return run


def mine(rows: DataFrame, anchors, n_positives: int = 5, n_negatives: int = 5, low_pct: int = 80, high_pct: int = 100, **how) -> DataFrame:
    """rows (vec_id long, label int, v array<double> of whole numbers, see ``scaled``) to anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score. anchors: a boolean column that says which rows are anchors.

    Scores are inner products, higher ones first, ties by smaller vec_id. An anchor's positives are its first ``n_positives`` other rows
    of its label. For each, the negatives are the first ``n_negatives`` rows of other labels whose score lies between ``low_pct``
    and ``high_pct`` per cent of the positive's (none if that is below 0 and the bounds cross). Exact, whatever the sample.
    Rows equal in id, label and vector count once; different rows of one id are rows, and anchors, of their own, and none is
    another row to the others. Vectors are compared with those of the same length only; empty ones score 0. Scores beyond a
    long are held at its ends. Other columns are ignored; no rows in, no rows out.
    """
    slim = rows.select("vec_id", "label", "v", F.coalesce(anchors, F.lit(False)).alias("anchor"))
    keep = max(n_positives, n_negatives) + 1
    once = slim.where("vec_id is not null and label is not null and v is not null").groupBy("vec_id", "label", "v").agg(F.max("anchor").alias("anchor"))
    once = save(once, "vectors")
    # equal vectors: only the smallest ids can be in an answer
    rank = F.row_number().over(Window.partitionBy("label", "v").orderBy("vec_id"))
    groups = once.select("vec_id", "label", "v", rank.alias("r")).where(F.col("r") <= keep).groupBy("label", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    index = MultiIndex(save(groups, "vector-groups"), **how)
    asked = save(once.where("anchor").select(F.monotonically_increasing_id().alias("akey"), "vec_id", "label", "v"), "anchors")
    open_ = F.array(F.struct(F.lit(0).alias("w"), F.lit(TOP).alias("hi"), F.lit(BOTTOM).alias("lo")))
    first = index.search(asked.withColumn("windows", open_), n_positives, True)
    order = Window.partitionBy("akey").orderBy(F.desc("score"), "vec_id")
    positives = save(first.select("akey", F.row_number().over(order).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    part = lambda pct: F.col("positive_score").cast("decimal(38,0)") * pct
    lo, hi = F.ceil(part(low_pct) / 100).cast("long"), F.floor(part(high_pct) / 100).cast("long")
    windows = positives.select("akey", F.struct("w", hi.alias("hi"), lo.alias("lo")).alias("s")).where("s.lo <= s.hi").groupBy("akey").agg(F.collect_list("s").alias("windows"))
    second = index.search(save(asked.join(windows, "akey"), "windows"), n_negatives, False)
    order = Window.partitionBy("akey", "w").orderBy(F.desc("negative_score"), "negative_id")
    out = second.select("akey", "w", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(positives, ["akey", "w"])
    out = out.withColumn("rank", F.row_number().over(order)).join(asked.select("akey", F.col("vec_id").alias("anchor_id")), "akey")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, list_dot_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, (row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id))::integer as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s on p.anchor_id = s.anchor_id and not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) <= 5
"""
