"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards.

1. Equal vectors of a label are collapsed. Centres fitted on a bounded sample cut each label into shards; a vector's own shard
   is that of its nearest centre, and it also lies in the next nearest, so shards overlap. Shards over the bound are split by hash.
2. In each shard a graph is built (nearest neighbours, robust pruning); a vector's adjacency lists from all its shards are united.
3. Range-expanding greedy search runs in each shard: from the medoid and a few entry points a beam walks to the query's
   neighbourhood, then spreads over the graph as long as it meets vectors near the threshold. Of the shards whose cells can hold a
   vector within the threshold (the distance to the cells' boundary decides) a query visits the nearest few, so its work doesn't
   grow with the number of shards.
4. Every pair found is verified by its cosine in double precision. A found vector counts only in its own shard, so counts
   add up. A link counts at both ends: where the found vector's own search doesn't visit the finder's shard, it is told. ``audit_recall``
   compares with brute force.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import connected_components, save

THRESHOLD = 0.93
#: Rows the centres are fitted on (all vectors are then indexed), vectors of a shard about, and the bound at which it is split.
SAMPLE, SHARD, SHARD_MAX = 20_000, 1_000, 4_000
DEGREE, ALPHA, BEAM, ENTRIES = 16, 1.2, 12, 4
#: Shards that a query visits; rows of the sample for each centre, at least.
PROBES, ROWS_A_CENTRE = 3, 8
#: Open vectors that a query goes on from at once.
WIDTH = 4
#: How far under the threshold a vector may be for the search to go on from it.
SLACK = 0.12


def normalised(vectors: DataFrame) -> DataFrame:
    """(vec_id, label with the vector's length, e: unit vector in doubles; both null where nothing can be compared)."""

    def run(batches):
        for b in batches:
            out, labels = [], []
            for e, label in zip(b["embedding"], b["label"]):
                x = None if e is None or pd.isna(label) else np.array(e, dtype=float)  # null components become nan
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    out.append(None)
                else:
                    x = x / np.abs(x).max()
                    out.append(x / np.sqrt((x * x).sum()))
                labels.append(None if out[-1] is None else f"{label}|{len(x)}")
            yield pd.DataFrame({"vec_id": b["vec_id"], "label": labels, "e": out})

    slim = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    return slim.mapInPandas(run, "vec_id long, label string, e array<double>")


def fit_centres(sample: pd.DataFrame, sizes: dict, shard: int, rounds: int = 8) -> dict:
    """label to centres, by k-means on the sample; one for each ``shard`` vectors of the label, as far as the sample has enough rows."""
    out = {}
    for label, rows in sample.groupby("label"):
        x = np.stack(rows["e"].to_numpy())
        k = max(1, min(len(x) // ROWS_A_CENTRE, math.ceil(sizes[label] / shard)))
        c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
        for _ in range(rounds if k > 1 else 1):
            own = np.argmax(x @ c.T - (c * c).sum(axis=1) / 2, axis=1)
            for j in range(k):
                if len(part := x[own == j]):
                    c[j] = part.mean(axis=0)
        out[label] = c
    return out


def robust_prune(near: np.ndarray, sims: np.ndarray, cross: np.ndarray, degree: int, alpha: float) -> list[int]:
    """Neighbours from near to far, leaving out those much closer to one already kept. cross: similarities among the candidates."""
    kept, open_ = [], np.ones(len(near), bool)
    for i in range(len(near)):
        if open_[i]:
            kept.append(int(near[i]))
            if len(kept) == degree:
                break
            open_ &= alpha * (1 - cross[i]) > (1 - sims)
            open_[: i + 1] = False
    return kept


def build_graph(ids: np.ndarray, x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[list[int]]:
    """Adjacency (vector ids) of a shard's vectors, in both directions."""
    n = len(x)
    if n == 1:
        return [[]]
    pool = min(n - 1, 2 * degree)
    links: list[set] = [set() for _ in range(n)]
    for at in range(0, n, 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        top = np.argpartition(-s, pool - 1, axis=1)[:, :pool]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1), 1)
        for r in range(len(s)):
            c = top[r]
            for j in robust_prune(c, s[r, c], x[c] @ x[c].T, degree, alpha):
                links[at + r].add(j)
                links[j].add(at + r)
    return [[int(ids[j]) for j in sorted(k)] for k in links]


def flat_lists(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency lists as one array and where each begins."""
    return np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([[0], np.cumsum([len(k) for k in lists])]).astype(np.int64)


def range_search(x: np.ndarray, graph: tuple[np.ndarray, np.ndarray], queries: np.ndarray, threshold: float, beam: int = BEAM, slack: float = SLACK, own: np.ndarray | None = None) -> list[np.ndarray]:
    """For each query the places of vectors it reaches with a cosine of at least threshold, by ``graph`` (see ``flat_lists``). own:
    the query's own place, where it is one of the vectors (else -1), from which it also starts. Single precision, with a
    margin; the caller verifies."""
    n, (ends, begin) = len(x), graph
    x, queries = x.astype(np.float32), queries.astype(np.float32)
    beam = min(beam, n)
    width = min(WIDTH, beam)
    centre = int(np.argmax(x @ x.mean(axis=0)))
    entry = np.unique(np.concatenate([[centre], np.linspace(0, n - 1, min(n, ENTRIES)).astype(int)]))
    out = []
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        sims = np.full((len(q), n), -2.0, np.float32)
        done = np.zeros((len(q), n), bool)
        sims[:, entry] = q @ x[entry].T
        if own is not None:
            known = np.flatnonzero(own[at : at + 256] >= 0)
            sims[known, own[at : at + 256][known]] = 1.0
        act = np.arange(len(q))
        while len(act):
            # every query goes on from the best open vectors of its beam; once that is closed, from all open ones near the threshold
            mine = sims[act]
            top = np.argpartition(-mine, beam - 1, axis=1)[:, :beam]
            score = np.take_along_axis(mine, top, 1)
            score[done[act[:, None], top]] = -3.0
            best = np.argpartition(-score, width - 1, axis=1)[:, :width]
            i, j = np.nonzero(np.take_along_axis(score, best, 1) > -2)
            r, b = act[i], np.take_along_axis(top, best, 1)[i, j]
            closed = np.setdiff1d(np.arange(len(act)), i)
            if len(closed):
                k, far = np.nonzero((mine[closed] >= threshold - slack) & ~done[act[closed]])
                r, b = np.concatenate([r, act[closed][k]]), np.concatenate([b, far])
            act = np.unique(r)
            done[r, b] = True
            size = begin[b + 1] - begin[b]
            rr = np.repeat(r, size)
            nn = ends[np.arange(len(rr)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[b], size)]
            fresh = sims[rr, nn] == -2.0
            rr, nn = rr[fresh], nn[fresh]
            sims[rr, nn] = np.einsum("ij,ij->i", q[rr], x[nn])
        out += [np.flatnonzero(s >= threshold - 1e-4) for s in sims]
    return out


def _search(threshold: float, beam: int, slack: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base = pdf[pdf["indexed"]].drop_duplicates("vec_id").sort_values("vec_id")
        asked = pdf[pdf["asked"]].drop_duplicates("vec_id").sort_values("vec_id")
        if base.empty or asked.empty:
            return pd.DataFrame({"vec_id": [], "n": [], "root": []}).astype("int64")
        ids, x = base["vec_id"].to_numpy(), np.stack(base["e"].to_numpy())
        lists = [np.searchsorted(ids, np.array(a, np.int64)) if a is not None else np.empty(0, np.int64) for a in base["links"]]
        lists = [k[(k < len(ids)) & (ids[np.minimum(k, len(ids) - 1)] == np.array(a if a is not None else [], np.int64))] for k, a in zip(lists, base["links"])]
        graph = flat_lists(lists)
        own, copies = base["own"].to_numpy(), base["copies"].to_numpy()
        q = np.stack(asked["e"].to_numpy())
        place = np.searchsorted(ids, asked["vec_id"].to_numpy()).clip(0, len(ids) - 1)
        place = np.where(ids[place] == asked["vec_id"].to_numpy(), place, -1)
        root = {int(i): int(i) for i in {*ids, *asked["vec_id"]}}

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        n = dict.fromkeys(asked["vec_id"].tolist(), 0)
        here = {int(p): k for k, p in enumerate(place) if p >= 0 and own[p]}  # places that are asked for in their own shard and split
        met = [set() for _ in q]
        for k, found in enumerate(range_search(x, graph, q, threshold, beam, slack, place)):
            met[k] = {int(j) for j in found[own[found] & (found != place[k])]}
        for k, found in enumerate(met):  # of two that are both at home here, what one has found the other has too
            if place[k] in here:
                for j in found:
                    if j in here:
                        met[here[j]].add(int(place[k]))
        visits, homes, weight = base["visits"].to_numpy(), asked["home"].to_numpy(), asked["copies"].to_numpy()
        for k, (v, found) in enumerate(zip(asked["vec_id"], met)):
            found = np.array(sorted(found), np.int64)
            found = found[(x[found] * q[k]).sum(axis=1) >= threshold]
            n[int(v)] += int(copies[found].sum())
            for j in found:
                if homes[k] not in visits[j]:
                    n[int(ids[j])] = n.get(int(ids[j]), 0) + int(weight[k])
                a, b = top(int(v)), top(int(ids[j]))
                root[max(a, b)] = min(a, b)
        asked_ids = asked["vec_id"].to_numpy()
        every = np.unique(np.concatenate([asked_ids, ids]))
        rows = [(int(i), n.get(int(i), 0), top(int(i))) for i in every if n.get(int(i), 0) or top(int(i)) != i]
        return pd.DataFrame(rows, columns=["vec_id", "n", "root"]).astype("int64")

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, shard: int = SHARD, shard_max: int = SHARD_MAX, beam: int = BEAM, slack: float = SLACK, probes: int = PROBES) -> DataFrame:
    """vectors (vec_id long, embedding array, label, …) to one row per input row: vec_id, n_links, component_id, kept.

    Vectors are linked if their labels are equal and not null and their cosine is at least threshold. Null, empty or zero
    vectors and those with null or non-finite components have no links; nor do vectors of different lengths. Equal vectors
    count as linked copies. Rows with a null vec_id come back with n_links 0, null component_id and kept false; repeated
    vec_ids come back each. Other columns are ignored; an empty table gives no rows.
    """
    rows = save(normalised(vectors), "vectors")
    content = F.xxhash64("e")
    content2 = F.md5(F.array_join(F.transform("e", lambda x: x.cast("string")), ",").cast("binary"))
    keyed = save(rows.where("e is not null").select("vec_id", "label", "e", content.alias("k1"), content2.alias("k2")), "vector-keys")
    groups = keyed.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("e").alias("e"))
    groups = save(groups, "vector-groups")
    nodes = groups.where("rep is not null").select(F.col("rep").alias("vec_id"), "label", "copies", "e")
    sizes = {r["label"]: r["n"] for r in nodes.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()}  # one row a label
    total = sum(sizes.values())
    each = F.xxhash64("vec_id", F.lit(7))
    part = nodes.withColumn("h", F.pmod(each, F.lit(1 << 20))).where(F.col("h") <= (1 << 20) * min(1.0, 1.2 * sample / max(total, 1)))
    fitted = fit_centres(part.select("label", "e", "h").orderBy("h", "label").limit(sample).toPandas(), sizes, shard) if total else {}

    def assign(batches):
        """Own shard, overlap shard, and the nearest shards whose cells reach to within the threshold."""
        reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
        for b in batches:
            out = []
            for label, g in b.groupby("label"):
                x = np.stack(g["e"].to_numpy())
                c = fitted.get(label)
                if c is None:  # no vector of it was in the sample
                    c = np.zeros((1, x.shape[1]))
                half = (c * c).sum(axis=1) / 2
                score = x @ c.T - half  # the largest is the nearest centre's
                order = np.argsort(-score, axis=1)
                own = order[:, 0]
                for r in range(len(x)):
                    gap = np.sqrt(np.maximum(2 * (half + half[own[r]] - c @ c[own[r]]), 1e-30))
                    close = order[r, :probes]
                    visit = {int(s) for s in close if s == own[r] or (score[r, own[r]] - score[r, s]) / gap[s] <= reach}
                    near = set(order[r, :2].tolist())
                    for s in near | visit:
                        out.append((g["vec_id"].iat[r], label, int(s), s == own[r], s in near, s in visit, int(own[r]), sorted(visit), g["copies"].iat[r], g["e"].iat[r]))
            yield pd.DataFrame(out, columns=["vec_id", "label", "shard", "own", "indexed", "asked", "home", "visits", "copies", "e"])

    spread = nodes.mapInPandas(assign, "vec_id long, label string, shard int, own boolean, indexed boolean, asked boolean, home int, visits array<int>, copies long, e array<double>")
    spread = save(spread, "vector-shards")
    crowd = spread.where("indexed").groupBy("label", "shard").agg(F.ceil(F.count("*") / shard_max).alias("splits"))
    placed = spread.join(crowd, ["label", "shard"], "left").withColumn("splits", F.coalesce("splits", F.lit(1)))
    # an indexed vector lies in one split; a query goes to all splits
    mine = F.pmod(F.xxhash64("vec_id"), F.col("splits"))
    placed = placed.withColumn("split", F.explode(F.when(F.col("asked"), F.sequence(F.lit(0).cast("long"), F.col("splits") - 1)).otherwise(F.array(mine))))
    placed = save(placed.withColumn("indexed", F.col("indexed") & (F.col("split") == mine)).drop("splits"), "vector-places")
    key = ["label", "shard", "split"]

    def build(pdf):
        ids = pdf["vec_id"].to_numpy()
        return pd.DataFrame({"vec_id": ids, "links": build_graph(ids, np.stack(pdf["e"].to_numpy()))})

    lists = placed.where("indexed").select(*key, "vec_id", "e").groupBy(*key).applyInPandas(build, "vec_id long, links array<long>")
    united = save(lists.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links")), "adjacency")  # at most two lists a vector
    found = placed.join(united, "vec_id", "left").groupBy(*key).applyInPandas(_search(threshold, beam, slack), "vec_id long, n long, root long")
    found = save(found, "vector-links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    comps = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))

    per_group = groups.join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    per_group = per_group.select("label", "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    linked = keyed.select("vec_id", "label", "k1", "k2").join(per_group, ["label", "k1", "k2"]).select("vec_id", "n_links", "component")
    alone = rows.where("e is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    out = linked.unionByName(alone).withColumn("known", F.col("vec_id").isNotNull())
    return out.select("vec_id", F.when(F.col("known"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(F.col("known"), F.col("component")).alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))


def audit_recall(vectors: DataFrame, result: DataFrame, threshold: float = THRESHOLD, every: int = 100) -> DataFrame:
    """Of the vectors whose id is divisible by ``every``: links found and links there are, by brute force against all vectors of
    the label. The queries are sent to all tasks in blocks, so no pairs are written out."""
    unit = normalised(vectors).where("e is not null")
    asked = unit.where((F.col("vec_id") % every) == 0).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(32)).cast("int"))
    other = unit.withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.lit(16)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(31))))
    asked = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(15))))

    def count(key, q, v):
        if q.empty or v.empty:
            return pd.DataFrame({"vec_id": [], "there": []}).astype("int64")
        s = np.stack(q["e"].to_numpy()) @ np.stack(v["e"].to_numpy()).T
        hit = (s >= threshold) & (q["vec_id"].to_numpy()[:, None] != v["vec_id"].to_numpy())
        return pd.DataFrame({"vec_id": q["vec_id"], "there": hit.sum(axis=1)})

    key = ["label", "block", "piece"]
    there = asked.groupBy(*key).cogroup(other.groupBy(*key)).applyInPandas(count, "vec_id long, there long").groupBy("vec_id").agg(F.sum("there").alias("there"))
    return there.join(result.select("vec_id", F.col("n_links").alias("found")), "vec_id")
