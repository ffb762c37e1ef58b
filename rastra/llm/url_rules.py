"""URL filter: explicit host and path rules, else association rules mined from labelled URLs.

DataFrame functions and Spark's FP-growth only.  A URL's tokens are its host labels (h:), its path words
without numbers (p:) and its query keys (q:).  FP-growth mines token sets of labelled URLs with the item
``!block``; rules tokens -> !block of enough support and confidence, and of lift above one, block.  Tokens that
occur in the very same labelled URLs are one item, the first of them: k of these would make 2**k sets that say the
same.  Rules are matched through an inverted index: each rule stands under its rarest token, and a URL that has
this token is tested for the others.  URLs of equal token sets are matched once.

Defined results: a url that is null or has no ``://`` has empty host and path, no rule, no tokens, and is allowed;
repeated rows are judged each; without labels, or without a rule that holds, the method allows; an empty table gives no
rows.  Columns of the input stay, save those named like an output, which are replaced.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from . import storage

BLOCK = "!block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    none = F.array().cast("array<string>")
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: (x != "") & ~x.rlike(r"^[0-9]+$")), lambda x: F.concat(F.lit("p:"), x))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    all_ = F.array_sort(F.array_distinct(F.concat(labels, words, keys)))
    return F.when(host != "", F.coalesce(all_, none)).otherwise(none)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (verdict, host, path) that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def merged(labelled: DataFrame, min_support: float) -> DataFrame:
    """(tokens, blocked) with frequent tokens only, one for all that occur in the very same rows.

    Rows are told by a hash of their tokens and label; a token's rows by their number and the sum of these hashes.  At most
    1 / min_support times the tokens of a row are frequent, so their table is broadcast.
    """
    rows = labelled.where("size(tokens) > 0").withColumn("__h", F.xxhash64("tokens", "blocked").cast("decimal(38,0)"))
    least = F.lit(min_support) * rows.count()
    each = rows.select(F.explode("tokens").alias("token"), "__h").groupBy("token").agg(F.count("*").alias("n"), F.sum("__h").alias("h")).where(F.col("n") >= least)
    first = each.groupBy("n", "h").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"))
    item = first.select(F.explode("tokens").alias("token"), "item").checkpoint()
    numbered = rows.select(F.monotonically_increasing_id().alias("__r"), "tokens", "blocked").checkpoint()
    found = numbered.select("__r", "blocked", F.explode("tokens").alias("token")).join(F.broadcast(item), "token")
    return found.groupBy("__r", "blocked").agg(F.array_sort(F.collect_set("item")).alias("tokens")).select("tokens", "blocked")


def mine(labelled: DataFrame, *, min_support: float = 0.002, min_confidence: float = 0.7) -> DataFrame:
    """Rules (antecedent, confidence, lift, support) from (tokens, blocked)."""
    items = F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCK)))).otherwise(F.col("tokens"))
    baskets = merged(labelled, min_support).select(items.alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=storage.partitions(labelled.sparkSession)).fit(baskets)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK) & (F.col("lift") > 1))
    return rules.select("antecedent", "confidence", "lift", "support")


def matches(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct token sets (tokens, n) that a rule fits, with the rule's best confidence; ``sets`` has how many rows hold each."""
    common = sets.select(F.explode("tokens").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))
    numbered = rules.select(F.monotonically_increasing_id().alias("r"), "antecedent", "confidence").checkpoint()
    anchor = numbered.select("r", F.explode("antecedent").alias("token")).join(common, "token").groupBy("r").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    index = numbered.join(anchor, "r").select("token", "antecedent", "confidence")
    index = F.broadcast(index) if numbered.count() <= 50_000 else index
    hits = sets.select("tokens", "n", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    return hits.groupBy("tokens").agg(F.max("n").alias("n"), F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labelled_urls: DataFrame, rules: list[tuple[str, str, str]], *, url_col: str = "url", **options) -> DataFrame:
    """``pages`` with host, path, rule, verdict, confidence; ``labelled_urls`` holds (url, blocked)."""
    storage.shared_dir(pages.sparkSession)
    new = {"host", "path", "rule", "verdict", "confidence"}
    url = F.col(url_col).cast("string")
    train = labelled_urls.where("blocked is not null").select(tokens_of(F.col("url"), host_of(F.col("url")), path_of(F.col("url"))).alias("tokens"), "blocked")
    mined = mine(train, **options).checkpoint()
    given = F.col("__rule")
    rows = pages.select(*[c for c in pages.columns if c not in new], host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    if mined.isEmpty():
        rows = rows.withColumn("confidence", F.lit(None).cast("double"))
    else:
        rows = rows.withColumn("__t", tokens_of(url, F.col("host"), F.col("path")))
        sets = rows.where("size(__t) > 0").groupBy(F.col("__t").alias("tokens")).agg(F.count("*").alias("n"))
        hits = matches(sets, mined).withColumnRenamed("tokens", "__t").checkpoint()
        # Rows of frequent sets get their rule by a broadcast; rows that surely have none need no join.
        total = hits.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        often = F.col("n") >= max(2, total / storage.HOT_KEYS)
        likely, none = storage.divided(rows, hits, "__t")
        hot = F.broadcast(hits.where(often).select("__t", "confidence"))  # at most HOT_KEYS rows
        rare = likely.join(hot.select("__t"), "__t", "left_anti").join(hits.where(~often).select("__t", "confidence"), "__t", "left")
        rows = likely.join(hot, "__t").unionByName(rare).unionByName(none.withColumn("confidence", F.lit(None).cast("double"))).drop("__t")
    verdict = F.coalesce(given["verdict"], F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return rows.withColumns({"rule": given["rule"], "verdict": verdict}).drop("__rule")
