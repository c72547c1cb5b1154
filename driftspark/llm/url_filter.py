"""URL verdicts: given rules on host and path first, else association rules mined from labelled URLs.

Spark's FP-growth finds combinations of URL tokens (host labels, domains, path segments, query keys) that often occur in
blocked pages. Rules that imply "block" are pruned by support, confidence and lift. A rule is filed under its rarest item (an
inverted index), so a URL meets only rules that share that item, and one containment test decides. DataFrame functions only.

What would only multiply the rules is taken out first, without any loss to the verdicts: tokens too rare for a rule; tokens that
stand in every URL; tokens that always occur together become one item, which a URL has if it has any of them; an item that is a
rule by itself needs no combinations.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import save

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with its path; the longest wins.
GIVEN = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.005, 0.6, 1.5
BLOCK = "=block"


def host_and_path(url):
    """Columns: host from the first :// up to / ? # or the end, A-Z lower-cased; path then up to ? or #. Null url or no ://: empty."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def tokens(url):
    """Distinct tokens of a url column; digits count as #, a null url has none."""
    host, path = host_and_path(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    domains = F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda n: F.concat(F.lit("d:"), F.array_join(F.slice(labels, -F.least(n, F.greatest(F.size(labels), F.lit(1))), F.least(n, F.greatest(F.size(labels), F.lit(1)))), ".")))
    steps = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")))
    keys = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("q:"), x))
    scheme = F.array(F.concat(F.lit("s:"), F.regexp_extract(url, r"(?s)^(.*?)://", 1)))
    every = F.array_distinct(F.concat(scheme, F.transform(labels, lambda x: F.concat(F.lit("h:"), x)), domains, steps, keys))
    return F.when(url.isNull(), F.array().cast("array<string>")).otherwise(every)


def items_of(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> tuple[DataFrame, int]:
    """(url, blocked boolean) to (token, item, freq, bad) and the number of rows. freq: rows with the item, bad: blocked ones. The
    item of tokens that stand in the same URLs, told by their number and two hashes of these URLs, is the least of them."""
    urls = labelled.groupBy("url").agg(F.count("*").alias("n"), F.count_if("blocked").alias("bad"))
    each = urls.withColumn("token", F.explode(tokens(F.col("url"))))
    mark = lambda seed: F.bit_xor(F.xxhash64("url", F.lit(seed)))
    stats = each.groupBy("token").agg(F.sum("n").alias("freq"), F.sum("bad").alias("bad"), mark(1).alias("x"), mark(2).alias("y"))
    n = labelled.count()
    stats = stats.where((F.col("bad") >= min_support * n) & (F.col("freq") < n))
    least = stats.groupBy("freq", "x", "y").agg(F.min("token").alias("item"))
    return stats.join(least, ["freq", "x", "y"]).select("token", "item", "freq", "bad"), n


def as_items(urls: DataFrame, items: DataFrame) -> DataFrame:
    """The rows' columns with the items of their url; rows without items are left out. A url's items are as many as its tokens."""
    named = urls.select("url").distinct().withColumn("token", F.explode(tokens(F.col("url")))).join(items.select("token", "item"), "token")
    return urls.join(named.groupBy("url").agg(F.collect_set("item").alias("items")), "url")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> tuple[DataFrame, DataFrame]:
    """(url, blocked boolean) to the items and the rules (rarest item, antecedent array<string>, confidence, support). No rows, no rules.

    What FP-growth lists is every frequent set of the items left, so k items that most URLs have, but not always together, and that
    say nothing alone give up to 2 ** k sets. No set is dropped to escape that; a larger ``min_support`` is the way to fewer."""
    labelled = labelled.where("url is not null")
    items, n = items_of(labelled, min_support)
    items = save(items, "url-items")
    blocked = labelled.where("blocked").count()
    alone = items.select("item", "freq", "bad").distinct()
    confidence = F.col("bad") / F.col("freq")
    single = (confidence >= min_confidence) & (confidence >= min_lift * blocked / max(n, 1))
    rules = alone.where(single).select(F.array("item").alias("antecedent"), confidence.alias("confidence"), (F.col("bad") / max(n, 1)).alias("support"), "item")
    left = items.join(alone.where(~single).select("item"), "item")
    rows = as_items(labelled, left).select(F.when(F.col("blocked"), F.array_append("items", F.lit(BLOCK))).otherwise(F.col("items")).alias("items"))
    # support counts all labelled rows, also those without items
    kept = rows.count()
    if kept:
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, min_support * n / kept), minConfidence=min_confidence).fit(rows)
        mined = model.associationRules.where((F.col("consequent")[0] == BLOCK) & (F.col("confidence") >= min_lift * blocked / n)).withColumn("support", F.col("support") * kept / n)
        filed = mined.withColumn("item", F.explode("antecedent")).join(alone, "item").groupBy("antecedent", "confidence", "support").agg(F.min(F.struct("freq", "item"))["item"].alias("item"))
        rules = rules.unionByName(filed)
    return items, save(rules, "url-rules")


def blocked_urls(urls: DataFrame, items: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls that some rule implies, with the best rule's confidence."""
    met = as_items(urls.select("url").where("url is not null").distinct(), items).withColumn("item", F.explode("items")).join(rules, "item")
    return met.where(F.size(F.array_except("antecedent", "items")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, given=GIVEN, **how) -> DataFrame:
    """pages (page_id, url, …), labels (doc_id = page_id, quality, toxic) to page_id, host, path, rule, verdict, confidence.

    A labelled page is blocked if its quality is 0 or it is toxic; several labels of an id count as blocked if one is, null
    labels as not. confidence is the best rule's of those not made longer than need be. verdict is the given rule's, else "block" if a mined rule fits, else "allow". Null or odd urls have empty host
    and path, and only mined rules can fit them. Repeated rows stay; an empty table gives no rows. Very long urls are read whole. Other columns are ignored.
    """
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("blocked"))
    slim = pages.select("page_id", F.col("url").cast("string"))
    items, rules = mine_rules(slim.join(marks, "page_id").select("url", "blocked"), **how)
    host, path = host_and_path(F.col("url"))
    mined = blocked_urls(slim, items, rules)
    out = slim.withColumn("host", host).withColumn("path", path)
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
    ranked = sorted(given, key=lambda x: -len(x[1] + x[2]))
    first = lambda value: F.coalesce(*(F.when(fits(h, p), F.lit(value(v, h, p))) for v, h, p in ranked)) if ranked else F.lit(None).cast("string")
    out = out.withColumn("rule", first(lambda v, h, p: h + p)).withColumn("given", first(lambda v, h, p: v))
    out = out.join(mined, "url", "left")
    verdict = F.coalesce("given", F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "confidence")
