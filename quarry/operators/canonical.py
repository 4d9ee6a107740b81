"""One table of findings: every agent's rows in one shape, merged, verified and summed up for each site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import model
from quarry.functions import text as txt
from quarry.operators import findings as ops

#: What an agent may tell of a finding; what it leaves out is null.
RAW = {
    "site": "string",
    "agent": "string",
    "rule": "string",
    "severity": "string",
    "cwe": "string",
    "title": "string",
    "url": "string",
    "file": "string",
    "line": "int",
    "selector": "string",
    "proof": "string",
    "artifact": "string",
    "reproducible": "boolean",
    "evidence_type": "string",
    "risk_eur": "double",
    "gain_eur": "double",
    "impact": "string",
    "fix": "string",
    "effort": "double",
    "verdict": "string",
    "reason": "string",
    "emit_seq": "bigint",
}
# Votes for and against of each verdict, the effort of a finding that tells none, the reason of one.
VOTES = {"confirmed": (3, 0), "plausible": (2, 1), "rejected": (0, 3)}
EFFORT, REASON = 0.3, "Observe directement."
PARTIAL = ("security",)


def raw(findings: DataFrame) -> DataFrame:
    """The columns of RAW alone, null where an agent has none."""
    return findings.select(*[(F.col(c) if c in findings.columns else F.lit(None)).cast(t).alias(c) for c, t in RAW.items()])


def united(*found: DataFrame) -> DataFrame:
    """All agents' findings as one table."""
    out = raw(found[0])
    for other in found[1:]:
        out = out.unionByName(raw(other))
    return out


def _told(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def canonical(findings: DataFrame) -> DataFrame:
    """Raw findings in the common shape, with site and loc_key.

    A finding stands at its url, else at its file and line.  Its risk is that
    of its severity, unless it tells one or tells a gain.
    """
    f = raw(findings)
    url, file = _told("url"), F.when(_told("url").isNull(), _told("file"))
    line = F.when(_told("url").isNull(), F.col("line"))
    votes = lambda i: F.coalesce(ops.literal_map({k: v[i] for k, v in VOTES.items()})[F.col("verdict")], F.lit(VOTES["confirmed"][i]))
    gain = F.coalesce("gain_eur", F.lit(0.0))
    risk = F.when(gain != 0, 0.0).otherwise(F.coalesce("risk_eur", ops.literal_map({k: float(v[5]) for k, v in model.SEVERITY.items()})[F.col("severity")], F.lit(0.0)))
    title = F.coalesce("title", "rule")
    return f.select(
        "site",
        txt.finding_id(F.col("agent"), F.col("rule"), F.coalesce(file, url, F.lit("g")), line).alias("id"),
        "agent",
        ops.literal_map({k: v[0] for k, v in model.AGENTS.items()})[F.col("agent")].alias("agent_n"),
        F.coalesce("emit_seq", F.lit(0)).alias("emit_seq"),
        ops.literal_map({k: v[1] for k, v in model.AGENTS.items()})[F.col("agent")].alias("family"),
        "rule",
        "cwe",
        title.alias("title"),
        "severity",
        F.struct(F.coalesce("evidence_type", F.when(_told("file").isNotNull(), "code").otherwise("prod")).alias("type"), "proof", F.coalesce("reproducible", F.lit(True)).alias("reproducible"), "artifact").alias("evidence"),
        F.struct(file.alias("file"), line.alias("line"), url.alias("url"), "selector").alias("location"),
        F.struct(F.when(gain != 0, "gain").otherwise("risk").alias("kind"), risk.alias("risk_eur"), gain.alias("gain_eur"), F.coalesce("impact", title).alias("impact")).alias("business"),
        F.struct(F.col("fix").alias("summary"), F.lit(None).cast("string").alias("patch"), F.lit(False).alias("opens_pr")).alias("fix"),
        F.coalesce("effort", F.lit(EFFORT)).alias("effort"),
        F.struct(F.coalesce("verdict", F.lit("confirmed")).alias("verdict"), votes(0).alias("votes"), votes(1).alias("refuters"), F.coalesce("reason", F.lit(REASON)).alias("reason")).alias("check"),
        F.concat_ws("::", txt.place(file, line, url, F.col("selector")), txt.slug(F.col("rule"))).alias("loc_key"),
    )


def first_only(findings: DataFrame) -> DataFrame:
    """The first row of each place and rule of a site, whatever the severity of others; by agent_n, emit_seq and id."""
    order = Window.partitionBy("site", "loc_key").orderBy("agent_n", "emit_seq", "id")
    return findings.withColumn("__place", F.row_number().over(order)).where(F.col("__place") == 1).drop("__place")


def security_report(findings: DataFrame) -> DataFrame:
    """The standing findings of the security agent, the first of each place and rule; worst first, then by risk."""
    kept = first_only(findings.where((F.col("agent") == "security") & (F.coalesce(F.col("check.verdict"), F.lit("")) != "rejected")))
    return kept.orderBy(ops.rank("severity", 0).desc(), F.col("business.risk_eur").desc(), "emit_seq", "id")


def merge(findings: DataFrame) -> DataFrame:
    """One finding for each site, place and rule: the first one's fields, the worst severity, raised_by in order of arrival, priority, low and high.

    Rejected findings are left out first.
    """
    standing = findings.where(F.coalesce(F.col("check.verdict"), F.lit("")) != "rejected").withColumn("rank", ops.rank("severity", 0))
    seq = F.struct("agent_n", "emit_seq", "id")
    own = [c for c in findings.columns if c not in ("site", "loc_key")]
    by_agent = standing.groupBy("site", "loc_key", "agent").agg(F.min(seq).alias("seq"), F.max(F.struct("rank", "severity")).alias("worst"), F.min_by(F.struct(*own), seq).alias("first"), F.count("*").alias("n"))
    whole = by_agent.groupBy("site", "loc_key").agg(
        F.min_by("first", "seq").alias("f"),
        F.max("worst").alias("worst"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "agent"))), lambda x: x["agent"]).alias("raised_by"),  # an agent each
        F.sum("n").alias("merged"),
    )
    out = whole.select("site", "loc_key", *[F.col(f"f.{c}").alias(c) for c in own if c != "severity"], F.col("worst.severity").alias("severity"), "raised_by", "merged")
    out = out.withColumn("verdict", F.col("check.verdict")).withColumn("priority", ops.priority()).drop("verdict")
    return ops.business(out)


def domains(merged: DataFrame, has_repo: bool = False) -> DataFrame:
    """For every agent of every site: n, score, worst, evaluated, partial, note; merged: of `merge`."""
    held = merged.groupBy("site", "agent").agg(F.count("*").alias("n"), F.sum(ops.rank() * ops.rank()).alias("penalty"), F.max(ops.rank("severity", 0)).alias("worst"))
    every = F.array(*[F.struct(F.lit(a).alias("agent"), F.lit(v[0]).alias("agent_n"), F.lit(v[1]).alias("family"), F.lit(v[2]).alias("weight")) for a, v in model.AGENTS.items()])
    grid = merged.select("site").distinct().select("site", F.explode(every).alias("a")).select("site", "a.*")
    bare = F.lit(False) if has_repo else F.col("agent").isin(*model.NEEDS_CODE)
    partial = F.lit(False) if has_repo else F.col("agent").isin(*PARTIAL)
    worst = F.coalesce(ops.literal_map({v[0]: k for k, v in model.SEVERITY.items()})[F.col("worst")], F.lit(""))
    n = F.coalesce("n", F.lit(0))
    note = (
        F.when(bare, "not evaluated without code")
        .when(partial & (n > 0), F.concat(n.cast("string"), F.lit(" on the outer surface; code not evaluated")))
        .when(partial, "clean outer surface; code not evaluated")
        .when(n == 0, "no problem found")
        .otherwise(F.concat(n.cast("string"), F.lit(" found, worst: "), worst))
    )
    return grid.join(held, ["site", "agent"], "left").select("site", "agent", "agent_n", "family", "weight", n.cast("long").alias("n"), worst.alias("worst"), (~bare).alias("evaluated"), partial.alias("partial"), F.when(~bare, ops.soft(F.coalesce("penalty", F.lit(0)), 40)).alias("score"), note.alias("note"))


def ordered_domains(told: DataFrame) -> DataFrame:
    """The domains of each site, evaluated ones first, best score first, with their place."""
    order = Window.partitionBy("site").orderBy(F.col("evaluated").desc(), F.col("score").desc_nulls_last(), "agent_n")
    return told.withColumn("place", F.row_number().over(order))


def synthesis(merged: DataFrame, has_repo: bool = False) -> DataFrame:
    """One row of figures for each site: scores, counts by severity, effort, risk and gain as ranges and middles, domains."""
    by = merged.groupBy("site").agg(
        F.count("*").alias("total_findings"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in model.SEVERITY],
        F.round(F.sum(F.coalesce("effort", F.lit(0.0))), 1).alias("effort_days"),
        ops.soft(F.sum(ops.weight("agent", 0.5) * ops.rank() * ops.rank()), 120).alias("score"),
        *[F.coalesce(F.sum(F.when(F.col("business.kind") == kind, F.col(end))), F.lit(0)).cast("long").alias(f"{kind}_{end}") for kind in ("risk", "gain") for end in ("low", "high")],
    )
    middle = lambda kind: F.floor((F.col(f"{kind}_low") + F.col(f"{kind}_high")) / 2 + 0.5).cast("long").alias(f"{kind}_eur")
    told = domains(merged, has_repo).groupBy("site").agg(
        F.floor(F.sum(F.when(F.col("evaluated"), F.col("score") * F.col("weight"))) / F.sum(F.when(F.col("evaluated"), F.col("weight"))) + 0.5).cast("long").alias("weighted_score"),
        F.count_if("evaluated").alias("evaluated_count"),
        F.count_if(~F.col("evaluated")).alias("not_evaluated_count"),
        F.max_by("agent", F.when(F.col("evaluated"), F.struct("score", -F.col("agent_n")))).alias("strongest"),
        F.min_by("agent", F.when(F.col("evaluated"), F.struct("score", "agent_n"))).alias("weakest"),
    )
    return by.select("*", middle("risk"), middle("gain")).join(told, "site")


def by_rule(found: DataFrame, most_proof: int = 6) -> DataFrame:
    """One row for each site and rule: the first page that breaks it, how many do, and the first paths, which the title and proof tell.

    found: site, page_id, url, agent, rule, severity.  Only the paths that are
    shown are gathered, ranked before they are.
    """
    paths = found.select("site", "agent", "rule", "severity", "page_id", "url", short_path(F.col("url"), F.col("site")).alias("path"))
    one = paths.groupBy("site", "agent", "rule", "severity", "path").agg(F.min(F.struct("page_id", "url")).alias("first"))
    order = Window.partitionBy("site", "agent", "rule", "severity").orderBy("first")
    shown = one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most_proof).groupBy("site", "agent", "rule", "severity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]), ", ").alias("paths"))
    counts = one.groupBy("site", "agent", "rule", "severity").agg(F.count("*").alias("pages"), F.min("first").alias("first"))
    told = counts.join(shown, ["site", "agent", "rule", "severity"])
    return told.select("site", "agent", "rule", "severity", "pages", F.col("first.page_id").alias("first_page"), F.col("first.url").alias("url"), F.concat(F.col("rule"), F.when(F.col("pages") > 1, F.concat(F.lit(" (on "), F.col("pages").cast("string"), F.lit(" pages)"))).otherwise("")).alias("title"), "paths")


def short_path(url: Column, site: Column) -> Column:
    """An address without its site; / if nothing is left."""
    return F.coalesce(F.nullif(F.when(F.startswith(url, site), F.substr(url, F.length(site) + 1)).otherwise(url), F.lit("")), F.lit("/"))
