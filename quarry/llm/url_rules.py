"""URL filters: given rules first, then association rules mined from labels.

Spark's FP-growth mines combinations of URL tokens that go with a label, to be
blocked or to be allowed; rules that pass the support and confidence asked for
are held in an inverted index from their rarest token, and the index is joined
with the tokens of each distinct URL shape, so that a shape is compared only
with rules of which it has that token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._util import checkpoint

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "label=block", "label=allow"
RULE_COLUMNS = "items array<string>, verdict string, confidence double, lift double, support double, key string"

#: The production rules: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host(url):
    """Column: what stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url):
    """Column: what follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def given(rules, host_column, path_column):
    """Columns (rule, verdict) of the longest given rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for told, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host_column == name) | F.endswith(host_column, F.lit("." + name))) & F.startswith(path_column, F.lit(start))
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(told)).otherwise(verdict)
    return rule, verdict


def tokens(url):
    """Column: the distinct tokens of a URL, ten at most: scheme, host, the host's last two labels and its first, the first and the last path word and all between, ending, query keys, fragment.

    Numbers name single pages and are left out.  Each kind has one token at
    most, however long the host or path, so that the sets of tokens that
    FP-growth counts stay few.
    """
    labels = F.split(host(url), r"\.")
    words = F.filter(F.split(F.regexp_replace(path(url), r"\.[A-Za-z]+$", ""), "/"), lambda s: (s != "") & ~s.rlike("^[0-9]+$"))
    ending = F.regexp_extract(path(url), r"(\.[A-Za-z]+)$", 1)
    query = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&"), lambda q: q != "")
    keys = F.array_join(F.array_sort(F.array_distinct(F.transform(query, lambda q: F.regexp_extract(q, "^([^=]*)", 1)))), "&")
    n, many = F.size(words), F.size(labels) > 2
    every = F.array(
        F.concat(F.lit("scheme="), F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z]+)://", 1)),
        F.when(host(url) != "", F.concat(F.lit("host="), host(url))),
        F.when(many, F.concat(F.lit("site="), F.element_at(labels, -2), F.lit("."), F.element_at(labels, -1))),
        F.when(many, F.concat(F.lit("first="), labels[0])),
        F.when(n > 0, F.concat(F.lit("path="), F.get(words, F.lit(0)))),
        F.when(n > 2, F.concat(F.lit("between="), F.array_join(F.slice(words, F.lit(2), F.greatest(n - 2, F.lit(0))), "/"))),
        F.when(n > 1, F.concat(F.lit("last="), F.get(words, n - 1))),
        F.when(ending != "", F.concat(F.lit("ending="), ending)),
        F.when(keys != "", F.concat(F.lit("query="), keys)),
        F.when(F.contains(F.coalesce(url, F.lit("")), F.lit("#")), F.lit("fragment")),
    )
    return F.array_sort(F.array_compact(every))


def mine(pages: DataFrame, labels: DataFrame, sample: int = 200_000, support: float = 0.002, lift: float = 1.2, sureness: float = 1.64, least: int = 10, url_column: str = "url") -> DataFrame:
    """items, verdict, confidence, lift, support, key: the mined rules, written already; key is a rule's rarest token.

    A page's label is that of the document its URL ends in; toxic documents
    and those of quality 0 are to be blocked, others allowed.  `sample` bounds
    the expected number of labelled pages read, taken by a hash of the URL.  A
    rule needs `support` of these and `least` pages that have its tokens and
    its label, and a confidence of `lift` times the label's share of all, which
    `sureness` standard errors of that share don't explain.  A rule that holds another rule's tokens is pruned if it isn't more certain.
    Pages without a number, null URLs and labels without an id teach nothing;
    labels that differ between rows of one id count as bad; fewer than `least`
    labelled pages, as in empty tables, give no rules.
    """
    from pyspark.ml.fpm import FPGrowth

    bad = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(((F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)).cast("int")).alias("bad"))
    url = F.col(url_column)
    numbered = pages.select(url.alias("url"), F.regexp_extract(url, "://[^?#]*/([0-9]+)[^/?#0-9]*/?([?#]|$)", 1).try_cast("bigint").alias("doc_id")).where(F.col("doc_id").isNotNull())
    labelled = numbered.join(bad, "doc_id")
    n = labelled.count()
    if n > sample:
        scale = 1 << 30
        labelled = labelled.where(F.pmod(F.xxhash64("url"), F.lit(scale)) < int(scale * sample / n))
    baskets = checkpoint(labelled.select(F.concat(tokens(F.col("url")), F.array(F.when(F.col("bad") == 1, BLOCK).otherwise(ALLOW))).alias("items")))
    n, blocked = baskets.agg(F.count("*"), F.count_if(F.array_contains("items", BLOCK))).first()
    if n < least:
        return labels.sparkSession.createDataFrame([], RULE_COLUMNS)
    share = min(s for s in (blocked / n, 1 - blocked / n) if s)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / n)), minConfidence=min(1.0, lift * share)).fit(baskets)
    verdict = F.substring(F.col("consequent")[0], 7, 9)
    usual = F.col("confidence") / F.col("lift")  # the label's share of all
    errors = (F.col("confidence") - usual) / F.sqrt(usual * (1 - usual) / (n * F.col("support") / F.col("confidence")))
    rules = checkpoint(model.associationRules.where(F.col("consequent")[0].isin(BLOCK, ALLOW) & (F.col("lift") >= lift)).select(F.array_sort("antecedent").alias("items"), verdict.alias("verdict"), "confidence", "lift", "support").where(errors >= sureness))
    # Tokens are ten at most, so a rule has 1,022 smaller sets of them at most.
    smaller = F.transform(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("items")) - 2), lambda m: F.filter("items", lambda _, i: m.bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0))
    parts = rules.where(F.size("items") > 1).select(F.col("items").alias("whole"), "verdict", F.col("lift").alias("own"), F.explode(smaller).alias("items"))
    lesser = parts.join(rules.select("items", "verdict", "lift"), ["items", "verdict"]).where(F.col("lift") >= F.col("own")).select(F.col("whole").alias("items"), "verdict").distinct()
    kept = rules.join(lesser, ["items", "verdict"], "left_anti")
    often = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("key"), "freq")
    key = kept.select("*", F.explode("items").alias("key")).join(often, "key").groupBy("items", "verdict", "confidence", "lift", "support").agg(F.min(F.struct("freq", "key")).alias("x"))
    return checkpoint(key.select("items", "verdict", "confidence", "lift", "support", "x.key"))


def judge(pages: DataFrame, mined: DataFrame | None = None, rules=RULES, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the tokens of the mined rule that fits best, or null) for each row.

    A given rule fits its host and all subdomains if the path starts with the
    rule's; the longest wins.  Where none fits, the mined rule of the greatest
    lift decides, of equal ones that with fewer tokens, then the first by its
    tokens; a URL without any is allowed.  A null URL, or one without ://, has
    empty host and path and no tokens but an empty scheme.  Null ids and
    repeated rows stay; an empty table gives no rows; other columns are not
    read.
    """
    url = F.col(url_column)
    base = pages.select(F.col(id_column).cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"), tokens(url).alias("tokens"))
    told = F.lit(None).cast("string")
    if mined is None:
        base = base.withColumn("mined", told).withColumn("told", told)
    else:
        shapes = base.select("tokens").distinct()
        hits = shapes.select("tokens", F.explode("tokens").alias("key")).join(mined, "key").where(F.size(F.array_except("items", "tokens")) == 0)
        best = hits.groupBy("tokens").agg(F.min(F.struct(-F.col("lift"), F.size("items"), "items", "verdict")).alias("x")).select("tokens", F.array_join("x.items", " ").alias("mined"), F.col("x.verdict").alias("told"))
        base = base.join(best, "tokens", "left")
    rule, verdict = given(rules, F.col("host"), F.col("path"))
    return base.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "told", F.lit("allow")).alias("verdict"), "mined")
