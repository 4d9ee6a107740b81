"""Writers and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.findings import top, worth_telling


def save(audits: DataFrame, path: str) -> None:
    """Audits as JSON, one folder for each tenant; a tenant's folder is replaced whole."""
    audits.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant").json(path)


def lines_of_json(events: DataFrame) -> DataFrame:
    """One JSON text for each row; null fields are left out."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def chat_message(findings: DataFrame, site: str, score: int, k: int = 5) -> str:
    """The worst findings as a short text; at most k rows reach the driver."""
    sign = "OK" if score >= 80 else "WARN" if score >= 50 else "BAD"
    rows = top(findings, k).collect()
    return "\n".join([f"[{sign}] {site} {score}/100", *[f"- {r['severity']}: {r['rule']} ({r['agent']})" for r in rows]])


def tickets(findings: DataFrame, least: str = "high", k: int = 15) -> DataFrame:
    """summary, priority, labels of at most k tickets."""
    names = F.create_map(*[F.lit(x) for x in ("critical", "Highest", "high", "High", "medium", "Medium", "low", "Low", "info", "Lowest")])
    return worth_telling(findings, least, k).select("seq", F.concat(F.lit("[audit] "), F.col("rule")).alias("summary"), names[F.col("severity")].alias("priority"), F.concat_ws(",", F.lit("audit"), "severity", "agent").alias("labels"))


def escaped(text):
    """Text for HTML; entities stay."""
    out = F.regexp_replace(text, r"&(?!#?[a-zA-Z0-9]+;)", "&amp;")
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


# The tiers of a report, the severities of each, and the score from which a domain is a strength.
TIERS = (("P0", "urgent", ("critical",)), ("P1", "within a week", ("high",)), ("P2", "within a month", ("medium",)), ("P3", "later", ("low", "info")))
STRONG = 85


def report(domains: DataFrame, title: str, score: int | None = None, findings: DataFrame | None = None, locked: bool = False):
    """The parts of a page that tells of one site's audit, one after the other.

    Head, domains (a fixed small dimension), strengths (fully evaluated
    domains of a high score), then the findings by tier, worst first, read row
    by row, so that the page is never whole in memory.  With `locked`, fixes
    are left out.  domains: agent, score, n, agent_n, and evaluated and partial
    where they are known; findings: severity, rule, agent, priority, and proof
    and fix where they are known.
    """
    word = "" if score is None else next(w for least, w in ((85, "solid"), (70, "good base"), (50, "to consolidate"), (0, "priority work")) if score >= least)
    rows = domains.orderBy(F.col("score").desc_nulls_last(), "agent_n").select(escaped(F.col("agent")).alias("agent"), "score", "n", (F.col("partial") if "partial" in domains.columns else F.lit(False)).alias("partial")).collect()
    yield f"<!doctype html><title>{title}</title><h1>{title}</h1>" + (f"<p>{score}/100: {word}</p>" if word else "")
    yield "<table>" + "".join(f"<tr><td>{r['agent']}</td><td>{'not evaluated' if r['score'] is None else r['score']}{' (partial)' if r['partial'] else ''}</td><td>{r['n']}</td></tr>" for r in rows) + "</table>"
    strong = [r["agent"] for r in rows if r["score"] is not None and r["score"] >= STRONG and not r["partial"]]
    yield "<h2>Strengths</h2><p>" + ", ".join(strong) + "</p>" if strong else ""
    if findings is None:
        return
    shown = lambda c: escaped(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in findings.columns else F.lit("")).alias(c)
    for name, label, severities in TIERS:
        some = findings.where(F.col("severity").isin(*severities)).orderBy(F.col("priority").desc(), "rule", "agent").select("severity", shown("rule"), shown("agent"), shown("proof"), shown("fix"))
        for i, r in enumerate(some.toLocalIterator()):
            fix = "reserved for the full audit" if locked else r["fix"]
            yield (f"<h2>{name}: {label}</h2>" if not i else "") + f"<p>[{r['severity']}] {r['rule']} ({r['agent']})<br>{r['proof']}<br>{fix}</p>"


def message(findings: DataFrame, summary: dict, site: str, k: int = 5) -> dict:
    """A chat message as blocks: head, figures, counts by severity, the k worst findings; summary: a row of canonical.synthesis."""
    score = summary.get("weighted_score") or 0
    counts = "  ".join(f"{summary[s]} {s}" for s in ("critical", "high", "medium", "low", "info") if summary.get(s)) or "0 findings"
    money = lambda n: f"{n or 0:,}".replace(",", " ")
    risk = f"{money(summary.get('risk_low'))} - {money(summary.get('risk_high'))} EUR" if summary.get("risk_low") or summary.get("risk_high") else "n/a"
    rows = top(findings, k).select("severity", "rule", "agent").collect()
    blocks = [{"type": "header", "text": f"[{'OK' if score >= 80 else 'WARN' if score >= 50 else 'BAD'}] {site}"}, {"type": "section", "fields": [f"Score {score}/100", f"Findings {summary.get('total_findings') or 0}", f"Effort {summary.get('effort_days', '?')} days", f"Risk {risk}"]}, {"type": "context", "text": counts}]
    if rows:
        blocks += [{"type": "divider"}, {"type": "section", "text": "\n".join(f"{r['severity']}: {r['rule']} ({r['agent']})" for r in rows)}]
    return {"text": f"{site}: {score}/100, {summary.get('total_findings') or 0} findings", "blocks": blocks}


def printed(findings: DataFrame, k: int = 12) -> list[str]:
    """Lines for a terminal: the counts by severity, then the k worst findings."""
    counts = {r["severity"]: r["n"] for r in findings.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    head = "   ".join(f"{counts.get(s, 0)} {s}" for s in ("critical", "high", "medium", "low", "info"))
    return [head, *[f"[{r['severity']}] {r['rule']} ({r['agent']})" for r in top(findings, k).collect()]]


def without_fixes(findings: DataFrame) -> DataFrame:
    """What the free tier shows."""
    return findings.drop("fix")


def added_files(findings: DataFrame, existing: DataFrame, site: str) -> DataFrame:
    """path, line, content of the files a pull request adds, a row for each of their entries; a path that exists is never written over.

    findings: rule, severity, verdict, file, seq, fix; existing: path.
    """
    from quarry.operators.audits import fixes_by_file

    lines = fixes_by_file(findings)
    marks = F.concat(F.when(F.col("place") == 1, F.concat(F.lit("## "), F.col("file"), F.lit("\n\n"))).otherwise(""), F.lit("- ["), F.col("severity"), F.lit("] "), F.col("fix"))
    report = lines.select(F.lit("AUDIT.md").alias("path"), F.struct("file", "place").alias("at"), marks.alias("content"))
    robots = findings.where("rule = 'no-robots'").select(F.lit("robots.txt").alias("path"), F.lit(f"User-agent: *\nAllow: /\n\nSitemap: {site.rstrip('/')}/sitemap.xml\n").alias("content")).distinct()
    every = report.unionByName(robots.select("path", F.struct(F.lit("").alias("file"), F.lit(1).alias("place")).alias("at"), "content"))
    order = Window.partitionBy("path").orderBy("at")
    return every.join(existing.select("path"), "path", "left_anti").select("path", F.row_number().over(order).alias("line"), "content")


def exit_code(findings: DataFrame) -> int:
    """1 if a finding is critical or high, else 0."""
    return 0 if findings.where(F.col("severity").isin("critical", "high")).isEmpty() else 1


def band(score):
    """Column: what a score says in a report."""
    return F.when(score >= 85, "solid").when(score >= 70, "good base").when(score >= 50, "to consolidate").otherwise("priority work")


def sign(score):
    """Column: the mark of a score in a message."""
    return F.when(score >= 80, "ok").when(score >= 50, "warn").otherwise("bad")


def euros(amount):
    """Column: a whole amount with spaces between thousands; null is 0."""
    whole = F.floor(F.coalesce(amount, F.lit(0)) + 0.5).cast("long")
    return F.replace(F.format_number(whole, 0), F.lit(","), F.lit(" "))


def branch(name):
    """Column: a branch's name: lower case, other characters made single hyphens, none at the ends, 24 characters at most."""
    return F.concat(F.lit("audit/"), F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 24))


def clean_host(target):
    """Column: an address without its scheme and a slash at its end."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(target, F.lit("")), "^https?://", ""), "/$", "")


def without_markdown(text):
    """Column: links become their words, white space single; 200 characters at most."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[([^\]]+)\]\([^)]+\)", "$1"), r"\s+", " ")), 1, 200)


def insert_findings(findings: DataFrame, path: str) -> None:
    """Append an audit's findings to the store: its columns, with the weakness that each names."""
    columns = ("audit_id", "agent", "family", "rule", "cwe", "title", "severity", "priority", "location", "business", "fix", "effort", "evidence", "check")
    findings.select(*columns).write.mode("append").parquet(path)
