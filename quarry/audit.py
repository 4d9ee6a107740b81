"""The whole audit of a set of pages: findings, merged, ranked and scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import findings as ops
from quarry.plans import page_rules


def page_findings(pages: DataFrame) -> DataFrame:
    """Every page finding with its place and arrival order."""
    found = page_rules.findings(pages)
    return found.select("page_id", "url", "agent", "rule", "severity", "effort", "verdict", "kind", F.concat_ws("::", F.col("url"), F.col("rule")).alias("loc_key"), (F.col("page_id") * 1000 + F.col("emit_seq")).alias("seq"))


def summary(pages: DataFrame) -> DataFrame:
    """agent, n, score, evaluated of an audit without source code."""
    return ops.domain_scores(page_findings(pages)).select("agent", "n", "score", "evaluated")


def isolated(spark, runners: dict, scope: DataFrame) -> DataFrame:
    """agent, rule, severity of every agent; one whose plan can't be made gives one finding that says so.

    runners: agent to a function of the scope that returns rule and severity.
    """
    found = spark.createDataFrame([], "agent string, rule string, severity string")
    for agent, run in runners.items():
        try:
            rows = run(scope).select(F.lit(agent).alias("agent"), "rule", "severity")
        except Exception:  # noqa: BLE001  an agent's fault is a finding
            rows = spark.createDataFrame([(agent, "agent-error", "info")], found.schema)
        found = found.unionByName(rows)
    return found
