"""Benchmark passages in documents, also with other numbers, names or units, by canonical templates.

Numbers, units after numbers and capitalised words inside a sentence become typed placeholders; pairs of the resulting words,
next to each other or with one between, are hashed and joined with those of the benchmark. Two slots side by side would meet
everywhere, so such a pair is hashed with its values. If half of an item's words agree at one offset, so many of them are that
close that no such offset is missed. A document's candidate offsets are then cut from its words in one go and laid word by word on
the items: words that agree count, and slots count if their values stand for each other one to one over the whole occurrence. Of several
occurrences in a document, as verbatim and with other values, the best one counts.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftspark.llm.common import save

#: Offsets at which fewer words of an item agree are no piece of it (unless fewer are enough to find it).
PIECE = 8
#: A document is contaminated by an item if so much of the item, and so many words (or all), are found in it.
COVERAGE, LEAST_WORDS = 0.5, 10
#: The benchmark's pairs of words are broadcast up to this number (about 20 MB), beyond it joined by a shuffle.
BROADCAST_WINDOWS = 400_000

# Units that may follow a number.
UNITS = "kilograms|kilogram|grams|gram|kg|mg|g|kilometers|kilometres|kilometer|km|meters|metres|meter|cm|mm|m|miles|mile|feet|foot|ft|inches|inch|liters|litres|liter|ml|l|hours|hour|h|minutes|minute|min|seconds|second|s|days|day|weeks|week|months|month|years|year|dollars|dollar|euros|euro|cents|cent|percent|degrees|degree"
# What stands before is looked at after the first letter or digit has matched, as few places have one.
NUMBER = r"\p{N}(?<![\p{L}\p{N}§]\p{N})\p{N}*(?:[.,:/]\p{N}+)*(?![\p{L}\p{N}])"
UNIT = rf"(\p{{N}}§ )({UNITS})(?![\p{{L}}\p{{N}}])"
NAME = r"\p{Lu}(?<=[\p{Ll},;] \p{Lu})\p{L}*(?![\p{L}\p{N}])"
#: A token of a tagged text: §n45§ for a number, §ukm for a unit after it, §pDerby for a name, or a word.
TOKEN = r"§n[^§]+|§[up]\p{L}+|[\p{L}\p{N}]+"


def tokens(text):
    """The lower-cased words of a text column, the slots marked by their kind, each with its own value: §n45, §ukm, §pderby. The
    source's own § are taken out first, so that every § is ours."""
    out = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("§"), F.lit(" ")), NAME, "§p$0")
    out = F.regexp_replace(F.regexp_replace(out, NUMBER, "§n$0§"), UNIT, "$1§u$2")
    return F.transform(F.regexp_extract_all(out, F.lit(TOKEN), F.lit(0)), F.lower)


def template(tokens):
    """The words of an array of tokens: §n, §u and §p stand for numbers, units and names."""
    return F.transform(tokens, _word)


def values(tokens):
    """What the slots of an array of tokens stand for, in their order."""
    return F.transform(F.filter(tokens, _slot), lambda x: F.substr(x, F.lit(3)))


def _word(t):
    return F.when(_slot(t), F.substring(t, 1, 2)).otherwise(t)


def pairs(tokens, single: bool):
    """(pos, h, slots) of the pairs that each word makes with the next words; with itself too, if there are items of one word. slots:
    the pair is of slots alone, and their values are part of its hash."""

    def made(d):
        def one(t, i):
            other = F.get(tokens, i + d)
            both = _slot(t) & _slot(other)
            h = F.when(both, F.xxhash64(t, other, F.lit(d))).otherwise(F.xxhash64(_word(t), _word(other), F.lit(d)))
            return F.struct(i.alias("pos"), h.alias("h"), both.alias("slots"))

        return F.slice(F.transform(tokens, one), 1, F.greatest(F.size(tokens) - d, F.lit(0)))

    return F.concat(*(made(d) for d in ([1, 2] + [0] * single)))


def sought_pairs(item: DataFrame) -> DataFrame:
    """item (item_id, item_key, item_tokens, item_words, least) to the pairs to look for: item_id, item_key, need, item_pos, h.

    ``least`` of the words agreeing at one offset make at least least - 1 - (item_words - least) / 2 close pairs, and all words
    make all pairs; a run of PIECE words has 2 * PIECE - 3. Pairs of slots alone are left out and taken off this number. Where
    none would be left, as in a list of numbers, which any other list would fit, the slots are sought with their values. Half of
    so many pairs, the commonest in the benchmark, are left out, and ``need`` of the others must meet at an offset.
    """
    n, m = F.col("item_words"), F.col("least")
    sure = F.greatest(F.least(F.when(m == n, 2 * n - 3).otherwise(m - 1 - F.floor((n - m) / 2)), F.lit(2 * PIECE - 3)), F.lit(1))
    own = F.when(n == 1, pairs(F.col("item_tokens"), True)).otherwise(pairs(F.col("item_tokens"), False))
    each = item.select("item_id", "item_key", sure.alias("sure"), own.alias("own")).withColumn("slots", F.size(F.filter("own", lambda p: p["slots"])))
    each = each.withColumn("typed", F.col("sure") > F.col("slots")).withColumn("sure", F.when(F.col("typed"), F.col("sure") - F.col("slots")).otherwise(F.col("sure")))
    each = each.withColumn("spare", F.floor((F.col("sure") - 1) / 2))
    each = each.select("item_id", "item_key", "spare", (F.col("sure") - F.col("spare")).alias("need"), F.explode(F.filter("own", lambda p: ~F.col("typed") | ~p["slots"])).alias("p"))
    each = each.select("item_id", "item_key", "spare", "need", "p.pos", "p.h")
    each = each.join(each.groupBy("h").agg(F.count("*").alias("common")), "h")
    rank = F.row_number().over(Window.partitionBy("item_id", "item_key").orderBy(F.desc("common"), "pos", "h"))
    return each.withColumn("rank", rank).where(F.col("rank") > F.col("spare")).select("item_id", "item_key", "need", F.col("pos").alias("item_pos"), "h")


def _slot(w):
    return w.startswith("§")


def _places(words):
    """Places, from 0, of the slots in an array column."""
    return F.filter(F.transform(words, lambda w, i: F.when(_slot(w), i).otherwise(F.lit(-1))), lambda i: i >= 0)


def _bound(value, body):
    """body(value) with value evaluated once: expressions inside a lambda are evaluated for every element, a variable isn't."""
    return F.transform(F.array(value), body)[0]


def _one_to_one(filled):
    """If the values of the slots stand for each other one to one."""
    pairs = lambda *names: F.size(F.array_distinct(F.transform(filled, lambda x: F.struct(*(x[n] for n in names)))))
    return (pairs("w", "a") == pairs("w", "a", "b")) & (pairs("w", "b") == pairs("w", "a", "b"))


def _best(laid):
    """(matched, verbatim) of the best occurrence. An occurrence is a run of offsets, in order, as long as their slots agree; one
    pass, and each offset is in one."""

    def scored(best, plain, filled, verbatim):
        now = F.struct((F.size(plain) + F.size(filled)).alias("matched"), verbatim.alias("verbatim"))
        return F.struct(F.greatest(best, now).alias("best"), plain.alias("plain"), filled.alias("filled"), verbatim.alias("verbatim"))

    def step(run, x):
        def joined(c):
            longer = c["ok"] & run["verbatim"].isNotNull()
            plain, filled = F.when(longer, F.array_union(run["plain"], x["plain"])).otherwise(x["plain"]), F.when(longer, c["filled"]).otherwise(x["filled"])
            verbatim = F.when(longer, run["verbatim"] & x["verbatim"]).otherwise(x["verbatim"])
            return _bound(F.struct(plain.alias("plain"), filled.alias("filled"), verbatim.alias("verbatim")), lambda y: scored(run["best"], y["plain"], y["filled"], y["verbatim"]))

        both = _bound(F.array_union(run["filled"], x["filled"]), lambda u: F.struct(u.alias("filled"), _one_to_one(u).alias("ok")))
        return _bound(both, joined)

    none = F.struct(F.lit(0).alias("matched"), F.lit(None).cast("boolean").alias("verbatim"))
    start = F.struct(none.alias("best"), F.slice(F.get(laid, 0)["plain"], 1, 0).alias("plain"), F.slice(F.get(laid, 0)["filled"], 1, 0).alias("filled"), F.lit(None).cast("boolean").alias("verbatim"))
    return F.aggregate(laid, start, step, lambda run: run["best"])


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least_words: int = LEAST_WORDS, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """docs (doc_id, text, …), benchmark (item_id, text, …) to one row per document and item found in it: doc_id, text_hash,
    item_id, matched_words, item_words, coverage, verbatim (all slots have the item's own values).

    Null, empty and very short texts match nothing; items without words are left out; every offset at which so many words
    agree is found (for a coverage over a third; of items that are mostly slots side by side, only where the values agree
    too). Very long texts and texts of numbers alone are read like others. Repeated rows count once for each distinct (doc_id, text).
    Neighbouring offsets of one item in a document are taken together if their slots agree. Other columns are ignored; empty tables give no rows.
    """
    doc = docs.select("doc_id", F.col("text").cast("string"), F.xxhash64("text").alias("text_hash"))
    item = benchmark.select("item_id", F.col("text").cast("string")).distinct()
    item = item.select("item_id", tokens(F.col("text")).alias("item_tokens")).where(F.size("item_tokens") > 0)
    item = item.select("*", template(F.col("item_tokens")).alias("item"), values(F.col("item_tokens")).alias("item_values"))
    item = item.select("*", F.size("item").alias("item_words"), _places(F.col("item")).alias("item_at"), F.xxhash64("item", "item_values").alias("item_key"))
    least = F.greatest(F.ceil(F.col("item_words") * coverage).cast("int"), F.least(F.lit(least_words), F.col("item_words")))
    item = save(item.withColumn("least", least), "benchmark")
    single = not item.where("item_words = 1").isEmpty()
    sought = save(sought_pairs(item), "sought")
    if sought.limit(broadcast_windows + 1).count() <= broadcast_windows:
        sought = F.broadcast(sought)
    words = doc.select("doc_id", "text_hash", _bound(tokens(F.col("text")), lambda t: pairs(t, single)).alias("pairs"))
    met = words.select("doc_id", "text_hash", F.explode("pairs").alias("w")).select("doc_id", "text_hash", F.col("w.pos").alias("pos"), F.col("w.h").alias("h"))
    met = met.join(sought, "h").groupBy("doc_id", "text_hash", "item_id", "item_key", "need", (F.col("pos") - F.col("item_pos")).alias("offset")).agg(F.count("*").alias("n"))
    offsets = met.where(F.col("n") >= F.col("need")).join(item.select("item_id", "item_key", "item_words"), ["item_id", "item_key"])
    # a document's offsets are no more than its words for each item
    offsets = save(offsets.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item_id", "item_key", "item_words", "offset")).alias("offsets")), "offsets")
    near = offsets.join(doc, offsets["doc_id"].eqNullSafe(doc["doc_id"]) & (offsets["text_hash"] == doc["text_hash"])).drop(doc["doc_id"], doc["text_hash"])
    near = near.dropDuplicates(["doc_id", "text_hash"])  # repeated rows; only of documents that have offsets

    def cut(t):  # the stretch of the document that lies on the item
        low = lambda o: F.greatest(o["offset"], F.lit(0))
        size = lambda o: F.greatest(F.least(o["item_words"] + o["offset"], F.size(t)) - low(o), F.lit(0))
        return F.transform("offsets", lambda o: F.struct(o["item_id"], o["item_key"], o["offset"], F.slice(t, low(o) + 1, size(o)).alias("seg")))

    near = near.select("doc_id", "text_hash", F.explode(_bound(tokens(F.col("text")), cut)).alias("c")).select("doc_id", "text_hash", "c.*")
    near = save(near, "stretches").join(item, ["item_id", "item_key"])
    near = near.withColumn("seg_values", values(F.col("seg"))).withColumn("seg", template(F.col("seg")))
    shift = F.least(F.col("offset"), F.lit(0))  # item place + shift is the stretch's place
    agree = F.transform("item", lambda w, j: F.when(j + shift >= 0, F.coalesce(F.get("seg", j + shift) == w, F.lit(False))).otherwise(F.lit(False)))
    near = near.select("doc_id", "text_hash", "item_id", "item_key", "item_words", "least", "offset", "item", "item_at", "item_values", "seg_values", _places(F.col("seg")).alias("seg_at"), agree.alias("agree"))
    near = near.where(F.size(F.filter("agree", lambda x: x)) >= F.least("least", F.lit(PIECE)))
    plain = F.filter(F.transform("agree", lambda x, j: F.when(x & ~_slot(F.get("item", j)), j).otherwise(F.lit(-1))), lambda j: j >= 0)
    value = lambda all_, k: F.try_element_at(all_, F.when(k > 0, k.cast("int")))
    filled = F.filter(F.transform("item_at", lambda j, k: F.struct(
        j.alias("j"), F.get("item", j).alias("w"), F.get("agree", j).alias("on"), F.get("item_values", k).alias("a"), value(F.col("seg_values"), F.array_position("seg_at", j + shift)).alias("b"),
    )), lambda x: x["on"] & x["a"].isNotNull() & x["b"].isNotNull())
    filled = F.transform(filled, lambda x: F.struct(x["j"], x["w"], x["a"], x["b"]))
    laid = near.select("doc_id", "text_hash", "item_id", "item_key", "item_words", "offset", plain.alias("plain"), filled.alias("filled"))
    laid = laid.withColumn("verbatim", F.forall("filled", lambda x: x["a"] == x["b"])).withColumn("filled", F.when(_one_to_one(F.col("filled")), F.col("filled")).otherwise(F.slice("filled", 1, 0)))
    found = laid.groupBy("doc_id", "text_hash", "item_id", "item_key", "item_words").agg(
        F.sort_array(F.collect_list(F.struct("offset", "plain", "filled", "verbatim"))).alias("laid"), F.size(F.array_distinct(F.flatten(F.collect_set("plain")))).alias("words"), F.min("verbatim").alias("same")
    )
    found = save(found, "laid")  # an item's offsets in one document: a few short rows
    found = found.withColumn("best", F.greatest(_best("laid"), F.struct(F.col("words").alias("matched"), F.col("same").alias("verbatim"))))
    found = found.select("*", F.col("best.matched").alias("matched_words"), F.col("best.verbatim").alias("verbatim")).withColumn("coverage", F.col("matched_words") / F.col("item_words"))
    kept = found.where((F.col("coverage") >= coverage) & (F.col("matched_words") >= F.least(F.lit(least_words), F.col("item_words"))))
    return kept.select("doc_id", "text_hash", "item_id", "matched_words", "item_words", "coverage", "verbatim")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents, with all their columns, in which no item is found."""
    bad = contaminated(docs, benchmark, **how).select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs["text"]) == bad["_bad_hash"]), "left_anti")
