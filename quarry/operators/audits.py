"""Operators on audits over time: history, trend, difference, tenants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


SERIOUS = ("critical", "high", "medium")


def history(audits: DataFrame, n: int = 20) -> DataFrame:
    """The newest n audits of each target: target, id, at, score, place (1 is the newest)."""
    newest = Window.partitionBy("target").orderBy(F.col("at").desc(), F.col("id").desc())
    return audits.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n)


def trend(audits: DataFrame, margin: int = 3) -> DataFrame:
    """Each audit with the previous score, the change and what it means; audits without a score are left out."""
    order = Window.partitionBy("target").orderBy("at", "id")
    told = audits.where("score is not null").withColumn("previous", F.lag("score").over(order))
    delta = F.col("score") - F.col("previous")
    return told.select("target", "id", "score", "previous", delta.alias("delta"), F.when(delta.isNull(), "baseline").when(delta < -margin, "regression").when(delta > margin, "improvement").otherwise("stable").alias("verdict"))


def difference(previous: DataFrame, current: DataFrame) -> DataFrame:
    """key, status (added, resolved, persisting), severity, regression, fixed (those of medium severity and more); the last row of a key on one side counts."""
    last = lambda df: df.groupBy("key").agg(F.max_by("severity", "seq").alias("severity"))
    a, b = last(previous).withColumnRenamed("severity", "before"), last(current).withColumnRenamed("severity", "after")
    both = a.join(b, "key", "full_outer")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "resolved").otherwise("persisting")
    return both.select("key", status.alias("status"), F.coalesce("after", "before").alias("severity")).withColumn("regression", (F.col("status") == "added") & F.col("severity").isin(*SERIOUS)).withColumn("fixed", (F.col("status") == "resolved") & F.col("severity").isin(*SERIOUS))


def domain_changes(domains: DataFrame) -> DataFrame:
    """target, domain, before, after, delta, place of domains scored in the last two audits of a target and changed; place 1 fell most."""
    order = Window.partitionBy("target", "domain").orderBy("at")
    recent = domains.withColumn("before", F.lag("score").over(order)).withColumn("newest", F.max("at").over(Window.partitionBy("target")))
    return recent.where((F.col("at") == F.col("newest")) & (F.col("before") != F.col("score"))).select("target", "domain", "before", F.col("score").alias("after"), (F.col("score") - F.col("before")).alias("delta")).withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy("delta", "domain")))


def members(members: DataFrame) -> DataFrame:
    """tenant, email, role, at, place of each tenant's members, in the order they came."""
    return members.withColumn("place", F.row_number().over(Window.partitionBy("tenant").orderBy("at", "email")))


def of_tenant(findings: DataFrame, audits: DataFrame, tenant: str) -> DataFrame:
    """Findings whose audit belongs to a tenant."""
    return findings.join(audits.where(F.col("tenant") == tenant).select("audit_id"), "audit_id", "left_semi")


def key_roles(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """request_id, tenant, role: no key is a public viewer, an unknown key owns a tenant of its own."""
    joined = requests.join(keys, "api_key", "left")
    from quarry.functions.text import base36, djb2

    own = F.concat(F.lit("t_"), base36(djb2(F.col("api_key"))))
    return joined.select("request_id", F.when(F.col("api_key").isNull(), "public").otherwise(F.coalesce("tenant", own)).alias("tenant"), F.when(F.col("api_key").isNull(), "viewer").otherwise(F.coalesce("role", F.lit("owner"))).alias("role"))


def upsert(members: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("tenant", "email"), order: str = "seq") -> DataFrame:
    """The rows of both with the last of each key."""
    every = members.unionByName(new)
    values = [c for c in every.columns if c not in keys]
    last = every.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in values if c != order])).alias("x"))
    return last.select(*keys, "x.*")


def listed(audits: DataFrame, n: int = 30) -> DataFrame:
    """The newest n audits of each tenant, with their place: tenant, id, target, status, score, at."""
    newest = Window.partitionBy("tenant").orderBy(F.col("at").desc(), F.col("id").desc())
    return audits.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n)


def completed(audits: DataFrame, n: int = 20) -> DataFrame:
    """The newest n finished audits of each tenant's target, with their place."""
    newest = Window.partitionBy("tenant", "target").orderBy(F.col("at").desc(), F.col("id").desc())
    return audits.where("status = 'done'").withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n)


def with_findings(audits: DataFrame, findings: DataFrame) -> DataFrame:
    """Each audit's rows with its findings, most urgent first by their place; an audit without findings is one row.

    audits: audit_id and others; findings: audit_id, finding_id, priority and others.
    """
    order = Window.partitionBy("audit_id").orderBy(F.col("priority").desc(), "finding_id")
    return audits.join(findings.withColumn("place", F.row_number().over(order)), "audit_id", "left")


def fixes_by_file(findings: DataFrame) -> DataFrame:
    """file, place, n, severity, fix: each standing finding's fix under its file, worst first; findings without a file stand under `general`."""
    from quarry.operators.findings import rank, standing

    kept = standing(findings).select(F.coalesce("file", F.lit("general")).alias("file"), (-rank()).alias("r"), "seq", "severity", "fix")
    order = Window.partitionBy("file").orderBy("r", "seq")
    return kept.withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("file"))).select("file", "place", "n", "severity", "fix")


def missing_translations(locales: DataFrame) -> DataFrame:
    """file, missing, keys: what other files of the set have; locales: file (text), key. With one file nothing can be missing.

    A key that all files have is dropped first; the others say which files
    have them, as one set of files a key, so no row is made for a pair that
    isn't missing.
    """
    here = locales.select("file", "key").distinct()
    names = sorted(r["file"] for r in here.select("file").distinct().collect())  # the locale files of one set: a few
    partial = here.groupBy("key").agg(F.collect_set("file").alias("have")).where(F.size("have") < len(names))
    gaps = partial.select("key", F.explode(F.array_except(F.array(*map(F.lit, names)).cast("array<string>"), "have")).alias("file"))
    return gaps.groupBy("file").agg(F.count("*").alias("missing"), F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys"))
