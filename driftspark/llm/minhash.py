"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

1. Each text becomes its set of word shingles. One permutation ``sigma`` is applied to the hashed shingles, a second one
   ``pi`` is shifted circularly by k; the minimum of ``pi(sigma(x) + k)`` is coordinate k of the signature.
2. Bands of ``rows`` coordinates are hashed; documents that share a band are candidates. Exact copies are collapsed first.
3. Links are confirmed on full shingle sets, in two passes that find every component without listing all pairs of a
   bucket: (a) each candidate against the hub of its bucket, the document whose bands are the most shared; (b) in buckets
   that (a) leaves in several components, all documents outside the hub's component against all others, in blocks of
   bounded size whose intersections come from one matrix product.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import connected_components, pieces, release_memory, save

SHINGLE = 5
#: 40 bands of 5: a pair at Jaccard 0.75 is missed with probability 2e-5, one at 0.8 with 1e-7.
BANDS, ROWS = 40, 5
#: A block of pass (b) holds about so many documents, or so many shingles if that is fewer.
BLOCK_DOCS, BLOCK_SHINGLES = 128, 60_000


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space (what bytes.lower and bytes.split do)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, k: int = SHINGLE) -> set:
    """Exact shingles; fewer than k words give the whole sequence as one; no words give the empty set."""
    w = words_of(text)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return set(zip(*(w[i:] for i in range(k))))


_A = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingle_hashes(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit shingle hashes of a document."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - k + 1
    x = np.zeros(n, np.uint64)
    for i in range(k):
        x = (x ^ (x >> np.uint64(31))) * _A[i % 8] + h[i : i + n]
    x ^= x >> np.uint64(29)
    x *= _A[7]
    x ^= x >> np.uint64(32)
    return np.unique(x)


def _mix(x: np.ndarray, m1: int, m2: int, tmp: np.ndarray) -> None:
    """A permutation of the 32-bit integers, in place."""
    for shift, m in ((16, m1), (15, m2)):
        np.right_shift(x, np.uint32(shift), out=tmp)
        np.bitwise_xor(x, tmp, out=x)
        np.multiply(x, np.uint32(m), out=x)
    np.right_shift(x, np.uint32(16), out=tmp)
    np.bitwise_xor(x, tmp, out=x)


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash: sigma once, then pi shifted by 0 .. size-1."""
    s = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    _mix(s, 0x7FEB352D, 0x846CA68B, np.empty_like(s))
    shifts = np.arange(size, dtype=np.uint32)
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 256):
        x = s[at : at + 256, None] + shifts
        _mix(x, 0x21F0AAAD, 0xD35A2D97, np.empty_like(x))
        np.minimum(least, x.min(axis=0), out=least)
    return least


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = np.arange(1, bands + 1, dtype=np.uint64) * _A[0]
    for r in range(rows):
        x = (x ^ sig[r::rows].astype(np.uint64)) * _A[1 + r % 6]
        x ^= x >> np.uint64(30)
    return x.view(np.int64)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE) -> DataFrame:
    """(doc_id, k1, k2: hash of the word sequence, n_shingles, bands); texts without words have null keys and bands."""

    def run(batches):
        for b in pieces(batches):
            ids, out = b.column(0), []
            for t in b.column(1):
                w = words_of(t.as_py())
                if not w:
                    out.append((None, None, 0, None))
                    continue
                d = xxhash.xxh3_128_digest(b" ".join(w))
                h = shingle_hashes(w, k)
                out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), len(h), band_keys(signature(h, bands * rows), bands, rows)))
            cols = list(zip(*out)) or [()] * 4
            yield pa.record_batch([ids, *(pa.array(cols[i], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))))], names=["doc_id", "k1", "k2", "n_shingles", "bands"])
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, k1 long, k2 long, n_shingles long, bands array<long>")


def _linked(similarity_pct: int, k: int):
    """A UDF on two text columns; the sets of recent texts are kept, as many rows share a hub."""

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        kept: OrderedDict = OrderedDict()

        def of(t):
            if t not in kept:
                kept[t] = shingle_set(t, k)
                if len(kept) > 8:
                    kept.popitem(last=False)
            return kept[t]

        out = []
        for x, y in zip(a, b):
            y, x = of(y), shingle_set(x, k)
            both = len(x & y)
            out.append(both > 0 and 100 * both >= similarity_pct * (len(x) + len(y) - both))
        kept.clear()
        release_memory()
        return pd.Series(out, dtype=bool)

    return linked


def _block_links(similarity_pct: int, k: int):
    """Links between components, of two blocks of a bucket: by the product of their document-shingle matrices."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["doc_id", "text"])
        number: dict = {}
        sets = [np.fromiter((number.setdefault(s, len(number)) for s in shingle_set(t, k)), dtype=np.int64) for t in pdf["text"]]
        sizes = np.array([len(s) for s in sets])
        often = np.bincount(np.concatenate([*sets, np.empty(0, np.int64)]), minlength=len(number)) > 1
        place = np.cumsum(often) - 1
        doc = np.repeat(np.arange(len(sets)), sizes)
        shingle = np.concatenate([*sets, np.empty(0, np.int64)])
        doc, shingle = doc[often[shingle]], place[shingle[often[shingle]]]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(often.sum()), 8192):  # exact in float32: below 2 ** 24
            here = (shingle >= at) & (shingle < at + 8192)
            x = np.zeros((len(sets), 8192), np.float32)
            x[doc[here], shingle[here] - at] = 1
            both += x @ x.T
        both = both.astype(np.int64)
        number.clear()
        if len(shingle) > 20_000:
            release_memory()
        comp = pdf["component"].to_numpy()
        i, j = np.nonzero((both > 0) & (100 * both >= similarity_pct * (sizes[:, None] + sizes - both)) & (comp[:, None] < comp))
        return pd.DataFrame({"a": comp[i], "b": comp[j]}, dtype="int64").drop_duplicates()

    return run


def near_duplicates(docs: DataFrame, similarity_pct: int = 75, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """docs (doc_id long, text string, …) to one row per input row: doc_id, n_shingles, component_id, kept.

    Texts are linked if 100 * |A and B| >= similarity_pct * |A or B| on their full shingle sets. component_id is the
    smallest doc_id that can be reached. Null, empty and blank texts: n_shingles 0, linked with nothing. Rows with a null
    doc_id come back with null component_id and kept false. Rows that share a doc_id count as one document with several
    texts; each comes back. Texts of any length are read whole, one at a time. Other columns are ignored. No rows in, no rows out.
    """
    sig = save(signatures(docs, bands, rows, k), "signatures")
    copies = sig.where("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    copies = save(copies.where("rep is not null"), "copies")
    one = sig.join(copies.select("k1", "k2", F.col("rep").alias("doc_id")), ["k1", "k2", "doc_id"], "left_semi")
    keys = one.select("doc_id", "n_shingles", F.explode("bands").alias("key")).distinct()
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = save(keys.join(shared, "key"), "members")

    popular = members.groupBy("doc_id").agg(F.sum("n").alias("popularity"))
    hubs = members.join(popular, "doc_id").groupBy("key").agg(F.max(F.struct("popularity", -F.col("doc_id"))).alias("h"))
    hubs = save(hubs.select("key", (-F.col("h.col2")).alias("hub")), "hubs")
    pairs = members.join(hubs, "key").where("doc_id <> hub").select("doc_id", "hub").distinct()
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = save(text.join(popular.select("doc_id"), "doc_id", "left_semi"), "texts")
    star = pairs.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("hub"), F.col("text").alias("hub_text")), "hub")
    links = save(star.where(_linked(similarity_pct, k)("text", "hub_text")).select(F.col("doc_id").alias("a"), F.col("hub").alias("b")), "star-links")
    found = connected_components(links)

    def labelled(df, key, name):
        return df.join(found.select(F.col("node").alias(key), F.col("component").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))

    own = labelled(members, "doc_id", "component")
    hub_own = labelled(hubs, "hub", "hub_component").select("key", "hub_component")
    own = own.join(hub_own, "key").withColumn("main", F.col("component") == F.col("hub_component"))
    blocks = lambda n, s: F.greatest(F.ceil(n / block_docs), F.ceil(s / block_shingles))
    buckets = own.groupBy("key").agg(
        F.count_if("main").alias("nm"), F.coalesce(F.sum(F.when(F.col("main"), F.col("n_shingles"))), F.lit(0)).alias("sm"),
        F.count_if(~F.col("main")).alias("ns"), F.coalesce(F.sum(F.when(~F.col("main"), F.col("n_shingles"))), F.lit(0)).alias("ss"),
    ).where("ns > 0 and nm + ns > 2").select("key", blocks(F.col("nm"), F.col("sm")).alias("bm"), blocks(F.col("ns"), F.col("ss")).alias("bs"))
    spread = own.join(buckets, "key").withColumn("h", F.xxhash64("doc_id"))
    # blocks 0 .. bs-1 hold what is outside the hub's component, bs .. bs+bm-1 the rest; a pair of blocks has one of the former
    spread = spread.withColumn("block", F.when(F.col("main"), F.col("bs") + F.pmod("h", "bm")).otherwise(F.pmod("h", "bs")))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("main"), F.col("bs")).otherwise(F.col("bs") + F.col("bm")) - 1)))
    spread = spread.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "component")
    late = spread.join(texts, "doc_id").groupBy("key", "i", "j").applyInPandas(_block_links(similarity_pct, k), "a long, b long")
    joined = connected_components(save(late, "block-links"))

    reach = copies.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    reach = reach.join(joined.select(F.col("node").alias("component"), F.col("component").alias("last")), "component", "left")
    reach = reach.select("k1", "k2", F.coalesce("last", "component").alias("reached"))
    out = sig.join(reach, ["k1", "k2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("reached", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The documents, with all their columns, without those that have an earlier near copy; of repeated rows (equal doc_id and text)
    one stays, that of the least hash over all columns. Rows with a null doc_id stay. Different texts under one doc_id are documents
    of their own. Of a group the least doc_id stays, and under it the text of the least hash. An empty table gives none; columns with
    any name are carried through. Reruns keep the same rows."""
    key = F.when(F.col("doc_id").isNotNull(), _own_key(docs))
    known = docs.where("doc_id is not null").select(key.alias("_key"), F.col("doc_id").cast("long").alias("_id")).distinct()
    near = near_duplicates(docs.select(key.alias("doc_id"), "text"), **how).where("doc_id is not null").select(F.col("doc_id").alias("_key"), "component_id").distinct()
    group = save(near.join(known, "_key"), "groups")
    stays = group.groupBy("component_id").agg(F.min(F.struct("_id", "_key")).alias("stays")).select("component_id", F.col("stays._key").alias("_stays"))
    away = group.join(stays, "component_id").where("_key <> _stays").select(F.col("_key").alias("_away"))
    rows = docs.join(away, key == away["_away"], "left_anti")
    repeated = save(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("_repeated")).agg(F.count("*").alias("n")).where("n > 1").select("_repeated"), "repeated-ids")
    once = F.struct(*(rows[c] for c in rows.columns))
    many = rows.join(repeated, rows["doc_id"] == repeated["_repeated"], "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(F.min_by(once, F.xxhash64(*(rows[c] for c in rows.columns))).alias("row"))
    return rows.join(repeated, rows["doc_id"] == repeated["_repeated"], "left_anti").unionByName(many.select("row.*"))


def _own_key(docs: DataFrame):
    """A hash column that tells all (doc_id, text) apart; checked by a second hash, and made anew should two share one."""
    for seed in range(8):
        key, check = F.xxhash64("doc_id", "text", F.lit(seed)), F.xxhash64(F.lit(seed), "text", "doc_id")
        if docs.where("doc_id is not null").groupBy(key.alias("key")).agg(F.min(check).alias("a"), F.max(check).alias("b")).where("a <> b").isEmpty():
            return key
    raise ValueError("no seed tells the documents apart")
