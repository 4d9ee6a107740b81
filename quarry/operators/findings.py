"""Operators on findings: merge, verify, rank, score and estimate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import model

CONFIDENCE = {"confirmed": 1.0, "plausible": 0.6}


def literal_map(values: dict):
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def rank(severity: str = "severity", otherwise: int = 1) -> Column:
    """A severity's rank; other words have `otherwise`."""
    return F.coalesce(literal_map({k: v[0] for k, v in model.SEVERITY.items()})[F.col(severity)], F.lit(otherwise))


def weight(agent: str = "agent", otherwise: float = 1.0) -> Column:
    return F.coalesce(literal_map({k: v[2] for k, v in model.AGENTS.items()})[F.col(agent)], F.lit(otherwise))


def standing(findings: DataFrame) -> DataFrame:
    """Findings that weren't rejected; without a verdict they stand."""
    return findings.where(F.coalesce(F.col("verdict"), F.lit("")) != "rejected")


def priority() -> Column:
    """round(rank^2 * weight * confidence / effort * 10), effort 0.1 at least and 1 if unknown."""
    sure = F.coalesce(literal_map(CONFIDENCE)[F.col("verdict")], F.lit(0.0))
    return F.floor(rank() * rank() * weight() * sure / F.greatest(F.lit(0.1), F.coalesce(F.col("effort"), F.lit(1.0))) * 10 + 0.5).cast("long")


def merge(findings: DataFrame) -> DataFrame:
    """One finding for each place and rule: the first row's fields, the worst severity, all agents by arrival.

    Findings: loc_key, seq, agent, severity, effort, verdict.  Partial
    aggregation keeps one struct for each key before the shuffle; only agents'
    first arrivals are gathered, at most one for each agent.
    """
    by_agent = findings.withColumn("rank", rank()).groupBy("loc_key", "agent").agg(F.min("seq").alias("seq"), F.max(F.struct("rank", "severity")).alias("worst"), F.min(F.struct("seq", "effort", "verdict")).alias("first"), F.count("*").alias("n"))
    return by_agent.groupBy("loc_key").agg(
        F.min(F.struct(F.col("seq"), F.col("agent"), F.col("first.effort").alias("effort"), F.col("first.verdict").alias("verdict"))).alias("f"),
        F.max("worst").alias("worst"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "agent"))), lambda x: x["agent"]), ",").alias("raised_by"),
        F.sum("n").alias("merged"),
    ).select("loc_key", "f.seq", "f.agent", F.col("worst.severity").alias("severity"), "f.effort", "f.verdict", "raised_by", "merged")


def by_severity(findings: DataFrame) -> DataFrame:
    """severity, n for all severities, zero where there are none."""
    spark = findings.sparkSession
    return model.severities(spark).select("severity").join(findings.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def soft(penalty: Column, half: int) -> Column:
    """100 without penalty, 50 at `half`."""
    return F.greatest(F.lit(0), F.floor(100 - 100 * penalty / (penalty + half) + 0.5)).cast("long")


def domain_scores(findings: DataFrame, has_repo: bool = False) -> DataFrame:
    """For every agent: n, score, worst rank, evaluated; agents that need code aren't evaluated without it."""
    stand = standing(findings).groupBy("agent").agg(F.sum(rank() * rank()).alias("penalty"))
    seen = findings.groupBy("agent").agg(F.count("*").alias("n"), F.max(rank("severity", 0)).alias("worst"))
    out = model.agents(findings.sparkSession).select("agent", "agent_n", "weight").join(seen, "agent", "left").join(stand, "agent", "left")
    evaluated = F.lit(True) if has_repo else ~F.col("agent").isin(*model.NEEDS_CODE)
    score = soft(F.coalesce("penalty", F.lit(0)), 40)
    return out.select("agent", "agent_n", "weight", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("worst", F.lit(0)).alias("worst"), evaluated.alias("evaluated"), F.when(evaluated, score).alias("score"))


def weighted_score(domains: DataFrame) -> DataFrame:
    told = domains.where("evaluated")
    return told.agg(F.floor(F.sum(F.col("score") * F.col("weight")) / F.coalesce(F.nullif(F.sum("weight"), F.lit(0.0)), F.lit(1.0)) + 0.5).cast("long").alias("weighted_score"), F.max_by("agent", F.struct("score", -F.col("agent_n"))).alias("strongest"), F.min_by("agent", F.struct("score", "agent_n")).alias("weakest"))


def health(findings: DataFrame) -> DataFrame:
    return standing(findings).agg(soft(F.coalesce(F.sum(weight("agent", 0.5) * rank() * rank()), F.lit(0.0)), 120).alias("health"))


def business(findings: DataFrame, visits: float | None = None, value: float | None = None, rate: float = 0.02) -> DataFrame:
    """The findings with low, high and basis of what they risk or gain."""
    bounds = lambda i: F.coalesce(literal_map({k: v[i] for k, v in model.SEVERITY.items()})[F.col("severity")], F.lit(0))
    low, high, basis = bounds(1).cast("long"), bounds(2).cast("long"), F.lit("severity")
    if visits and value:
        revenue, acts = visits * 12 * rate * value, F.col("agent").isin(*model.CONVERSION_AGENTS)
        part = lambda i: F.floor(bounds(i) * revenue + 0.5).cast("long")
        low, high, basis = F.when(acts, part(3)).otherwise(low), F.when(acts, part(4)).otherwise(high), F.when(acts, "calibrated").otherwise(basis)
    return findings.select("*", low.alias("low"), high.alias("high"), basis.alias("basis"))


def business_totals(findings: DataFrame, **options) -> DataFrame:
    return business(findings, **options).groupBy("kind", "basis").agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.count("*").alias("n"))


def ranked(findings: DataFrame) -> DataFrame:
    """The findings with rank and priority; `top` and the writers put them in order."""
    return findings.withColumn("rank", rank("severity", 0)).withColumn("priority", priority())


def top(findings: DataFrame, k: int = 10) -> DataFrame:
    """The k worst findings, worst first."""
    return ranked(findings).orderBy(F.col("rank").desc(), F.col("priority").desc(), "seq").limit(k)


def quick_wins(findings: DataFrame, most: float = 0.25, k: int = 10) -> DataFrame:
    return top(findings.where(F.coalesce(F.col("effort"), F.lit(1.0)) <= most), k)


def roadmap(findings: DataFrame) -> DataFrame:
    bucket = literal_map({"critical": "now", "high": "week", "medium": "month", "low": "backlog", "info": "backlog"})[F.col("severity")]
    return findings.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("effort"), 1).alias("effort_days"))


def by_tier(findings: DataFrame) -> DataFrame:
    """tier, n: P0 for critical findings to P3 for low ones and information."""
    tier = literal_map({"critical": "P0", "high": "P1", "medium": "P2", "low": "P3", "info": "P3"})[F.col("severity")]
    return findings.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


def active_agents(scopes: DataFrame) -> DataFrame:
    """site, agent of the agents that apply to a site; scopes: site, repo, database. Unknown counts as no."""
    has = {"hasRepo": "repo", "hasDatabase": "database"}
    apt = F.lit(True)
    for activation, fact in has.items():
        apt = F.when(F.col("activation") == activation, F.coalesce(F.col(fact), F.lit(False))).otherwise(apt)
    return scopes.join(F.broadcast(model.agents(scopes.sparkSession)), how="cross").where(apt).select("site", "agent")


def worth_telling(findings: DataFrame, least: str = "high", k: int = 15) -> DataFrame:
    """The k worst findings of at least a severity."""
    return top(findings.where(rank("severity", 0) >= model.SEVERITY[least][0]), k)


def verified(findings: DataFrame, scope: DataFrame, default_reason: str = "Observe directement.") -> DataFrame:
    """Findings with the verdict, votes and refuters of an ordered cascade: kept rejections, facts that decide, missing evidence, own checks.

    findings: site, rule, severity, verdict, reason, proof, file, url,
    artifact, reproducible; scope: facts about each site, one row of one site.
    A finding of a site without facts is judged as if nothing was there.
    """
    body = F.coalesce("body", F.lit(""))
    ld = body.rlike(r"(?i)application/ld\+json")
    present = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(False)).otherwise(F.lit(True))
    meta = lambda key: ~body.rlike(rf"(?i)<meta(?![0-9A-Za-z_])(?=[^>]*{key})(?=[^>]*(?<![0-9A-Za-z_])content\s*=\s*[\"'])[^>]*>")
    facts = {
        "no-security-txt": present("security_txt"),
        "no-sitemap": present("sitemap"),
        "no-robots": present("robots"),
        "no-llms-txt": present("llms"),
        "no-structured-data": ~ld,
        "no-jsonld-geo": F.when(~ld, F.lit(True)),
        "missing-viewport": meta("name=[\"']viewport"),
        "missing-og": meta("property=[\"']og:title"),
        "no-analytics": F.when(body.rlike(r"(?i)gtag\(|googletagmanager|google-analytics|plausible\.io|matomo|posthog"), F.lit(False)),
    }
    held = F.lit(None).cast("boolean")
    for rule, fact in facts.items():
        held = F.when(F.col("rule") == rule, fact).otherwise(held)
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    evidence = some("proof") | some("file") | some("url") | some("artifact")
    own = F.col("verdict").isNotNull() & some("reason") & (F.col("reason") != default_reason)
    vote = lambda verdict, votes, refuters: F.struct((F.lit(verdict) if isinstance(verdict, str) else verdict).alias("verdict"), F.lit(votes).alias("votes"), F.lit(refuters).alias("refuters"))
    told = (
        F.when(F.col("verdict") == "rejected", vote("rejected", 0, 3))
        .when(held == F.lit(False), vote("rejected", 0, 3))
        .when(held, vote("confirmed", 3, 0))
        .when(~evidence & (rank() >= 4), vote("plausible", 1, 2))
        .when(F.col("reproducible") == F.lit(False), vote("plausible", 2, 1))
        .when(own & (F.col("verdict") == "confirmed"), vote("confirmed", 3, 0))
        .when(own, vote(F.col("verdict"), 2, 1))
        .when(some("proof"), vote("confirmed", 3, 0))
        .otherwise(vote("plausible", 2, 1))
    )
    facts_of = scope.select("site", "body", "sitemap", "robots", "llms", "security_txt")
    joined = findings.join(facts_of, "site", "left").withColumn("told", told)
    return joined.select(*[c for c in findings.columns if c != "verdict"], "told.*")


def weight_shares(spark) -> DataFrame:
    return model.agents(spark).select("agent", F.round(100 * F.col("weight") / F.sum("weight").over(Window.partitionBy()), 2).alias("share"))
