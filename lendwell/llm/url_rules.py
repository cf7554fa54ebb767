"""URL filter by association rules, beside a list of given host and path rules.

Urls are cut into tokens (words of the host, of the path, names of query parameters, ending,
fragment). Tokens that are frequent in blocked urls are looked at:

1. A token that alone implies the block label with enough confidence is a rule; combinations with it
   would add nothing, so it is left out of the rest.
2. Tokens that occur in exactly the same labelled urls become one item, which stands for all of them.
3. Spark's FP-growth mines the items of all labelled urls together with the label. Its association
   rules from combinations of items to the label are kept by support and confidence.

Rules are matched by an inverted index: each rule is listed under its least frequent token, the tokens
of the different urls are joined with that list, and a rule holds when the url has all its tokens.

A url is labelled by whoever calls: the registered query blocks pages whose document is
labelled low or toxic, and, as weak labels, urls with a word of a list of spam words.

Given rules name a host and the start of a path; the longest that fits decides, and mined
rules decide for all other urls. Mined rules are shown for every url that one fits.

Cases: a url that is null or has no ``://`` has an empty host and path, no tokens, and is
allowed; long urls are cut into tokens whole; repeated rows each give a row; null labels are left out;
without labelled urls nothing is mined; of several rules that fit, the first in order of text is shown; other
columns do not matter; no pages give no rows. Combinations grow with the number of frequent items that vary within one url,
as FP-growth does; the first two steps take out those that do not vary.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendwell.llm.common import small_side
from lendwell.session import checkpointed

ALLOW, BLOCK = "allow", "block"
# A mined rule holds in this share of the labelled urls and in so many of them, at least.
MIN_SUPPORT = 0.001
MIN_URLS = 10
MIN_CONFIDENCE = 0.9
# Words that mark spam sites, as weak labels.
SPAM_WORDS = ("bet", "bets", "betting", "casino", "pills", "poker", "porn", "viagra", "xxx", "ads")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


GIVEN = (
    Rule(ALLOW, "com", "/"),
    Rule(BLOCK, "example.com", "/en/"),
    Rule(ALLOW, "www.example.com", "/en/"),
    Rule(BLOCK, "net", "/es/"),
    Rule(BLOCK, "net", "/fr/"),
)


def lower(column: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(column, UPPER, LOWER)


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return lower(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url, each marked by its place."""

    def marked(mark: str, text: Column, pattern: str, group: int = 0) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda w: F.concat(F.lit(mark), w))

    rest = after_scheme(url)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    found = F.concat(
        marked("host:", host, r"[^.:@\-_]+"),
        marked("path:", lower(path), r"[^/.\-_]+"),
        marked("ending:", lower(path), r"\.([^/.]+)/?$", 1),
        marked("query:", lower(query), r"(?:^|&)([^=&]+)", 1),
        marked("fragment:", lower(F.regexp_extract(rest, r"^[^#]*#(.*)", 1)), r"[^/.\-_]+"),
    )
    return F.array_distinct(found)


def given_rule(rules: Sequence[Rule]) -> Column:
    """The longest given rule that fits, as a struct of its name and verdict, or null."""
    fitting = [
        F.when(
            ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host)))
            & F.startswith(F.col("path"), F.lit(r.path)),
            F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in sorted(rules, key=lambda r: (-len(r.name), -len(r.host)))
    ]
    return F.coalesce(*fitting, F.lit(None).cast("struct<rule:string,verdict:string>"))


RULES = "rule_tokens array<string>, confidence double, support double"


def merged_items(flat: DataFrame) -> DataFrame:
    """``token, item, tokens``: tokens of the same rows are one item, named by the first of them.

    Rows are told by their number and two sums of hashes of row numbers.
    """
    rows_of = flat.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.hash("row").cast("long")).alias("s")
    )
    # At most (tokens of a url) / MIN_SUPPORT tokens are frequent.
    items = rows_of.groupBy("n", "x", "s").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    return items.select(F.explode("tokens").alias("token"), F.col("tokens")[0].alias("item"), "tokens")


def mined_rules(
    labelled: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_urls: int = MIN_URLS,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """``rule_tokens, confidence, support`` from rows of ``url, blocked``."""
    url = F.col("url").cast("string")
    rows = checkpointed(
        labelled.filter(F.col("blocked").isNotNull()).select(
            F.monotonically_increasing_id().alias("row"),
            F.col("blocked").cast("boolean").alias("blocked"),
            tokens_of(url, host_of(url), path_of(url)).alias("tokens"),
        )
    )
    total = rows.count()
    none = rows.sparkSession.createDataFrame([], RULES)
    if not total:
        return none
    # Support counts all labelled urls, also those without a frequent token.
    needed = max(min_urls, math.ceil(Fraction(str(min_support)) * total))
    flat = rows.select("row", "blocked", F.explode("tokens").alias("token"))
    frequent = checkpointed(
        flat.groupBy("token")
        .agg(F.count_if("blocked").alias("blocked"), F.count(F.lit(1)).alias("urls"))
        .filter(F.col("blocked") >= needed)
    )
    confidence = F.col("blocked") / F.col("urls")
    single = confidence >= min_confidence
    alone = frequent.filter(single).select(
        F.array("token").alias("rule_tokens"), confidence.alias("confidence"), (F.col("blocked") / total).alias("support")
    )
    rest = frequent.filter(~single).select("token")
    number = rest.count()
    if number < 2:
        return alone
    kept = checkpointed(flat.join(small_side(rest, number), "token"))
    items = checkpointed(merged_items(kept))
    sets = (
        kept.join(small_side(items.select("token", "item"), number), "token")
        .groupBy("row", "blocked")
        .agg(F.collect_set("item").alias("items"))
    )
    label = F.when(F.col("blocked"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))
    baskets = checkpointed(sets.select(F.concat("items", label).alias("items")))
    # Half an url less, so that the product does not round up to one url more.
    share = (needed - 0.5) / baskets.count()
    mined = FPGrowth(itemsCol="items", minSupport=min(share, 1.0), minConfidence=min_confidence).fit(baskets)
    to_block = mined.associationRules.filter(F.col("consequent")[0] == BLOCK)
    numbered = checkpointed(
        to_block.select(F.sort_array("antecedent").alias("antecedent"), "confidence", (F.col("support") * F.lit(float(baskets.count())) / total).alias("support"))
    )
    tokens = items.select("item", "tokens").distinct()
    spelled = (
        numbered.select("*", F.explode("antecedent").alias("item"))
        .join(small_side(tokens, number), "item")
        .groupBy("antecedent", "confidence", "support")
        .agg(F.sort_array(F.flatten(F.collect_list("tokens"))).alias("rule_tokens"))
    )
    return alone.unionByName(spelled.select("rule_tokens", "confidence", "support"))


def inverted_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Each rule under its least frequent token: ``token, rule_tokens``."""
    parts = rules.select("rule_tokens", F.explode("rule_tokens").alias("token"))
    used = parts.select("token").distinct()
    counts = (
        urls.select(F.explode("tokens").alias("token"))
        .join(small_side(used, used.count()), "token", "left_semi")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("urls"))
    )
    return (
        parts.join(counts, "token", "left")
        .groupBy("rule_tokens")
        .agg(F.min_by("token", F.struct(F.coalesce(F.col("urls"), F.lit(0)), F.col("token"))).alias("token"))
    )


def judged(pages: DataFrame, labelled: DataFrame, given: Sequence[Rule] = GIVEN) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined_rule`` for every row of ``pages`` (page_id, url)."""
    url = F.col("url").cast("string")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), url.alias("url"),
        host_of(url).alias("host"), path_of(url).alias("path"),
    )
    rules = checkpointed(mined_rules(labelled))
    count = rules.count()
    listed = given_rule(given)
    if count:
        different = rows.select("url", "host", "path").filter("url IS NOT NULL").distinct()
        urls = different.select("url", tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
        index = small_side(checkpointed(inverted_index(rules, urls)), count)
        hits = checkpointed(
            urls.withColumn("token", F.explode("tokens"))
            .join(index, "token")
            .filter(F.size(F.array_except("rule_tokens", "tokens")) == 0)
            .groupBy("url")
            .agg(F.min(F.concat_ws(" ", "rule_tokens")).alias("mined_rule"))
        )
        found = rows.filter("url IS NOT NULL").join(small_side(hits, hits.count()), "url", "left")
        rows = found.unionByName(rows.filter("url IS NULL").withColumn("mined_rule", F.lit(None).cast("string")))
    else:
        rows = rows.withColumn("mined_rule", F.lit(None).cast("string"))
    by_method = F.when(F.col("mined_rule").isNotNull(), BLOCK).otherwise(ALLOW)
    return rows.withColumn("given", listed).select(
        "page_id", "host", "path",
        F.col("given.rule").alias("rule"),
        F.coalesce(F.col("given.verdict"), by_method).alias("verdict"),
        "mined_rule",
    )


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url, blocked`` of pages whose document (the number that ends the path) is labelled, or whose url has a spam word."""
    url = F.col("url").cast("string")
    number = F.regexp_extract(path_of(url), r"/([0-9]{1,18})(?:\.[a-z]+|/)?$", 1)
    words = F.split(host_of(url), r"[^a-z]+")
    rows = pages.select(
        url.alias("url"),
        F.when(number != "", number.cast("long")).alias("page_doc"),
        F.arrays_overlap(words, F.array(*[F.lit(w) for w in SPAM_WORDS])).alias("spam"),
    )
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), True).when(F.col("quality") == 1, False)
    by_doc = (
        labels.select(F.col("doc_id").alias("page_doc"), bad.alias("bad"))
        .groupBy("page_doc")
        .agg(F.max("bad").alias("bad"))
    )
    blocked = F.when(F.coalesce(F.col("spam"), F.lit(False)), True).otherwise(F.col("bad"))
    return rows.join(by_doc, "page_doc", "left").select("url", blocked.alias("blocked")).filter("blocked IS NOT NULL")
