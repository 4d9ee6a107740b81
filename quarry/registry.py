"""The agents of an audit: what each runs, on which facts, and the run of all of them."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import model
from quarry.operators import canonical
from quarry.plans import line_rules, page_rules, response_rules, site_rules


@dataclass(frozen=True)
class Request:
    """What somebody wants audited. Bad values raise; the number of pages is held within 1 and 30."""

    target: str
    repo: str | None = None
    max_pages: int = 1
    monthly_visits: float | None = None
    conversion_value: float | None = None
    conversion_rate: float = 0.02

    def __post_init__(self):
        if not self.target or not re.match(r"(?i)^(https?://)?[^\s/?#:]+(:\d+)?([/?#]|$)", self.target):
            raise ValueError("target must be an address of http or https")
        if self.repo is not None and not re.fullmatch(r"https://[\w.-]+/[\w./-]+", self.repo):
            raise ValueError("repo must be a plain https address")
        for name in ("monthly_visits", "conversion_value", "conversion_rate"):
            value = getattr(self, name)
            if value is not None and not value >= 0:
                raise ValueError(f"{name} must not be negative")
        object.__setattr__(self, "max_pages", max(1, min(30, int(self.max_pages))))

    def business(self) -> dict:
        """The options of findings.business."""
        return {"visits": self.monthly_visits, "value": self.conversion_value, "rate": self.conversion_rate}


#: agent: functions of the frames of an audit, each giving raw findings with a site.
RUNNERS: dict[str, list[Callable[[Mapping[str, DataFrame]], DataFrame]]] = {}


def runs(*agents: str):
    """Register a function of an audit's frames for agents; it gives columns of canonical.RAW, `agent` too where it serves several."""

    def register(f):
        for agent in agents:
            RUNNERS.setdefault(agent, []).append(f)
        return f

    return register


def of_origin(url):
    from quarry.operators.links import origin

    return origin(url)


@runs(*page_rules.AGENTS)
def pages(frames):
    """Rules over pages; frames: pages (page_id, url, html, and status and error where they are known)."""
    found = page_rules.findings(eligible(frames["pages"]))
    values = {r.id: (r.gain, r.risk) for r in page_rules.RULES}
    money = lambda i: F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v[i]))])[F.col("rule")]
    return found.select(of_origin(F.col("url")).alias("site"), "agent", "rule", "severity", "url", "effort", "verdict", F.nullif(money(0), F.lit(0.0)).alias("gain_eur"), F.nullif(money(1), F.lit(0.0)).alias("risk_eur"), (F.col("page_id") * 1000 + F.col("emit_seq")).alias("emit_seq"), F.lit("found on the page").alias("proof"))


@runs("seo", "geo", "infra", "perf")
def sites(frames):
    """Rules over a site's facts; frames: sites, as site_rules.site_findings has them."""
    return site_rules.site_findings(frames["sites"]).select("*", F.col("site").alias("url"), F.lit("not there").alias("proof"))


# Severity, effort and weakness of the rules over answers.
ANSWERS = {
    "missing-csp": ("high", 0.5, "CWE-693"),
    "missing-hsts": ("medium", 0.1, "CWE-693"),
    "missing-xcto": ("low", 0.1, "CWE-693"),
    "missing-frame": ("medium", 0.1, "CWE-693"),
    "missing-referrer": ("info", 0.1, "CWE-693"),
    "missing-permissions-policy": ("info", 0.2, "CWE-693"),
    "server-version": ("low", 0.1, "CWE-693"),
    "powered-by": ("low", 0.1, "CWE-693"),
    "no-tls": ("high", 0.3, "CWE-319"),
    "csp-no-default-src": ("medium", 0.3, "CWE-693"),
    "csp-unsafe-inline": ("medium", 0.4, "CWE-693"),
    "csp-unsafe-eval": ("medium", 0.4, "CWE-693"),
    "csp-wildcard": ("medium", 0.4, "CWE-693"),
    "hsts-short-maxage": ("low", 0.1, "CWE-319"),
    "hsts-no-subdomains": ("info", 0.1, "CWE-319"),
}
SPEED = {"no-compression": ("medium", 0.1, 1500.0), "weak-cache": ("low", 0.2, 800.0)}


@runs("security")
def answers(frames):
    """Rules over headers; frames: responses (url, headers, probe_origin)."""
    found = response_rules.header_findings(frames["responses"]).unionByName(response_rules.policy_findings(frames["responses"]))
    told = lambda i: F.create_map(*[F.lit(x) for k, v in ANSWERS.items() for x in (k, v[i])])[F.col("rule")]
    return found.where(F.col("rule").isin(*ANSWERS)).select(of_origin(F.col("url")).alias("site"), "url", "rule", told(0).alias("severity"), told(1).alias("effort"), told(2).alias("cwe"), F.lit("header").alias("proof"))


@runs("perf")
def speed(frames):
    found = response_rules.header_findings(frames["responses"]).where(F.col("rule").isin(*SPEED))
    told = lambda i: F.create_map(*[F.lit(x) for k, v in SPEED.items() for x in (k, v[i])])[F.col("rule")]
    return found.select(of_origin(F.col("url")).alias("site"), "url", "rule", told(0).alias("severity"), told(1).alias("effort"), told(2).alias("gain_eur"), F.lit("header").alias("proof"))


@runs("security")
def code(frames):
    """Rules over lines of source; frames: files (repo, file, lang, text). Placeholders and dull strings are rejected, doubtful code is plausible."""
    files = frames["files"].select(F.struct("repo", "file").alias("at"), "lang", "text")
    secrets = line_rules.secret_verdicts(line_rules.scan(files, line_rules.SECRETS, "at", "text", "lang")).drop("bits")
    risky = line_rules.code_verdicts(line_rules.scan(files, line_rules.CODE, "at", "text", "lang"))
    found = secrets.unionByName(risky)
    return found.select(F.col("file.repo").alias("site"), F.col("file.file").alias("file"), F.col("n").alias("line"), "rule", "severity", "effort", "cwe", "verdict", F.col("match").alias("proof"), F.col("match").alias("artifact"), F.col("n").cast("bigint").alias("emit_seq"))


@runs("code-arch")
def structure(frames):
    return _repository(site_rules.code_findings(frames["files"]))


@runs("infra")
def environment(frames):
    return _repository(site_rules.env_findings(frames["files"]))


def _repository(found: DataFrame) -> DataFrame:
    return found.select(F.col("repo").alias("site"), "file", "line", "rule", "severity", "effort", F.col("n").cast("string").alias("proof"))


def eligible(found: DataFrame) -> DataFrame:
    """Pages that were answered with 200, without an error; where neither is known all are."""
    for column, fits in (("status", F.col("status") == 200), ("error", F.col("error").isNull())):
        if column in found.columns:
            found = found.where(fits)
    return found


def run(spark: SparkSession, frames: Mapping[str, DataFrame], runners: Mapping[str, list] | None = None, active: tuple[str, ...] | None = None) -> DataFrame:
    """The raw findings of all active agents whose frames are there.

    A runner whose frame is missing has nothing to look at.  One whose plan
    can't be made gives one `agent-error` finding, not reproducible, and the
    others go on.
    """
    owners: dict[Callable, list[str]] = {}
    for agent in model.AGENTS:
        if active is None or agent in active:
            for f in (RUNNERS if runners is None else runners).get(agent, ()):
                owners.setdefault(f, []).append(agent)
    out = []
    for f, agents in owners.items():
        try:
            found = f(frames)
        except KeyError:
            continue
        except Exception as e:  # noqa: BLE001  an agent's fault is a finding
            out += [spark.createDataFrame([(a, "agent-error", "info", 0.0, False, type(e).__name__)], "agent string, rule string, severity string, effort double, reproducible boolean, proof string") for a in agents]
            continue
        out += [found.where(F.col("agent").isin(*agents))] if "agent" in found.columns else [found.withColumn("agent", F.lit(a)) for a in agents]
    return canonical.united(*out) if out else canonical.raw(spark.createDataFrame([], "agent string"))


def audit(spark: SparkSession, frames: Mapping[str, DataFrame], scope: DataFrame | None = None, **options) -> DataFrame:
    """The merged findings of a run: in one shape, verified against the facts of their sites where `scope` has them, merged, ranked and estimated."""
    from quarry.operators import findings as ops

    found = run(spark, frames, **options)
    if scope is not None:
        found = ops.verified(found, scope).drop("votes", "refuters")
    return canonical.merge(canonical.canonical(found))
