"""The dimensions of an audit, as fixed values."""

from __future__ import annotations

#: severity: (rank, low and high euros, low and high share of conversion revenue, default risk in euros)
SEVERITY = {
    "critical": (5, 5000, 20000, 0.02, 0.06, 15000),
    "high": (4, 2000, 8000, 0.01, 0.03, 6000),
    "medium": (3, 500, 2500, 0.003, 0.01, 1500),
    "low": (2, 100, 500, 0.001, 0.003, 300),
    "info": (1, 0, 0, 0.0, 0.0, 0),
}
#: agent: (number, family, weight, activation)
AGENTS = {
    "security": (1, "technique", 1.0, "always"),
    "code-arch": (2, "technique", 0.7, "hasRepo"),
    "infra": (3, "technique", 0.9, "always"),
    "data": (4, "technique", 0.8, "hasDatabase"),
    "deps": (5, "technique", 0.85, "always"),
    "perf": (6, "technique", 0.9, "always"),
    "seo": (7, "visibilite", 0.85, "always"),
    "geo": (8, "visibilite", 0.6, "always"),
    "analytics": (9, "visibilite", 0.6, "always"),
    "email": (10, "visibilite", 0.5, "always"),
    "a11y": (11, "humain", 0.9, "always"),
    "ux": (12, "humain", 0.7, "always"),
    "content": (13, "humain", 0.6, "always"),
    "legal": (14, "risque", 0.95, "always"),
    "cro": (15, "risque", 0.7, "always"),
}
CONVERSION_AGENTS = ("seo", "geo", "perf", "ux", "cro", "content", "a11y")
NEEDS_CODE = ("deps", "code-arch", "data")


def severities(spark):
    return spark.createDataFrame([(k, *v) for k, v in SEVERITY.items()], "severity string, rank int, lo int, hi int, conv_lo double, conv_hi double, risk_eur int")


def agents(spark):
    return spark.createDataFrame([(k, *v) for k, v in AGENTS.items()], "agent string, agent_n int, family string, weight double, activation string")


def pages_allowed(asked):
    """Column: how many pages an audit may read, 1 to 30; 1 where nothing is asked."""
    from pyspark.sql import functions as F

    return F.least(F.lit(30), F.greatest(F.lit(1), F.coalesce(asked, F.lit(1))))
