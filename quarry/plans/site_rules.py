"""Rules over facts of a whole site, and over what is known of its repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.expr import java
from quarry.plans.line_rules import DEBUG, LARGE_FILE, TODO
from quarry.plans.response_rules import MIXED

# Agent, rule, severity, effort and gain of the site rules, limits, and patterns of files.
SLOW_MS = 800
CODE_FILE = r"\.(js|ts|jsx|tsx|mjs|cjs|py|go|rb|php|java)$"
DATA_FILE = r"\.(js|ts|jsx|tsx|mjs|cjs|py|rb|php|sql|prisma)$"
TEST_FILE = r"\.(test|spec)\.|__tests__|(^|/)tests?/"
SCHEMA_FILE = r"(?i)schema\.(prisma|sql)$|\.sql$"
MIGRATIONS = r"(?i)migrations?[^/]*/"
ENV_FILE, ENV_SAMPLE = r"(^|/)\.env(\.[^/]*)?$", r"\.(example|sample)$"
SKIPPED = r"(^|/)(node_modules|\.git|dist|build|\.next|out|coverage|vendor)/"
LARGEST, MOST_LARGE, FEW_FILES = 800_000, 5, 8


def absent(column: str) -> Column:
    return ~F.coalesce(F.col(column), F.lit(False))


def site_rules() -> list[tuple[str, str, str, float, int, Column]]:
    """(agent, rule, severity, effort, gain, when) over: sitemap, robots, llms, security_txt, ttfb_ms, http_status, http_location, caa_ok, caa; null facts of requests prove nothing."""
    redirects = F.col("http_status").between(300, 399) & F.coalesce(F.col("http_location"), F.lit("")).rlike("(?i)^https:")
    return [
        ("seo", "no-sitemap", "medium", 0.3, 0, absent("sitemap")),
        ("seo", "no-robots", "low", 0.1, 0, absent("robots")),
        ("geo", "no-llms-txt", "medium", 0.3, 0, absent("llms")),
        ("infra", "no-security-txt", "info", 0.1, 0, absent("security_txt")),
        ("perf", "high-ttfb", "medium", 0.5, 1500, F.col("ttfb_ms") > SLOW_MS),
        ("infra", "no-https-redirect", "high", 0.2, 0, F.col("http_status").isNotNull() & ~redirects),
        ("infra", "no-caa", "low", 0.2, 0, F.coalesce(F.col("caa_ok"), F.lit(False)) & (F.size(F.coalesce("caa", F.array().cast("array<string>"))) == 0)),
    ]


def site_findings(scopes: DataFrame) -> DataFrame:
    """site, agent, rule, severity, effort, gain_eur for each rule that a site breaks; scopes: site and the facts of `site_rules`."""
    rows = [F.when(when, F.struct(F.lit(agent).alias("agent"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(effort).alias("effort"), F.lit(gain).alias("gain_eur"))) for agent, rule, severity, effort, gain, when in site_rules()]
    return scopes.select("site", F.explode(F.array_compact(F.array(*rows))).alias("f")).select("site", "f.*")


def mixed_content(pages: DataFrame) -> DataFrame:
    """page_id, url, n, proof: pages over https that load parts over plain http; pages: page_id, url, html."""
    found = F.regexp_extract_all("html", F.lit(java(MIXED)), F.lit(0))
    held = pages.where(F.startswith("url", F.lit("https://"))).select("page_id", "url", found.alias("found"))
    return held.where(F.size("found") > 0).select("page_id", "url", F.size("found").cast("long").alias("n"), F.substring(F.col("found")[0], 1, 120).alias("proof"))


def cors_findings(answers: DataFrame) -> DataFrame:
    """url, rule, severity of answers that let any origin read them; answers: url, probe_origin, allow_origin, allow_credentials."""
    trusted = F.lower(F.coalesce("allow_credentials", F.lit(""))) == "true"
    open_ = (F.col("allow_origin") == F.col("probe_origin")) | ((F.col("allow_origin") == "*") & trusted)
    return answers.where(F.coalesce(open_, F.lit(False))).select("url", F.lit("cors-reflected-origin").alias("rule"), F.when(trusted, "high").otherwise("medium").alias("severity"))


# Repositories. files: repo, file (path below the repository), text.


def _finding(df: DataFrame, rule: str, severity: str, effort, file, line, n) -> DataFrame:
    return df.select("repo", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), (effort if isinstance(effort, Column) else F.lit(effort)).alias("effort"), file.alias("file"), line.cast("int").alias("line"), n.cast("long").alias("n"))


def code_counts(files: DataFrame) -> DataFrame:
    """repo, file, test, read, lines, todo, first_todo, debug, first_debug of each source file; those over 800,000 bytes aren't read."""
    kept = files.where(F.col("file").rlike(CODE_FILE) & ~F.col("file").rlike(SKIPPED))
    read = F.octet_length(F.coalesce("text", F.lit(""))) <= LARGEST
    rows = kept.select("repo", "file", F.col("file").rlike(TEST_FILE).alias("test"), read.alias("read"), F.split(F.when(read, F.coalesce("text", F.lit(""))).otherwise(""), "\r?\n").alias("rows"))
    hits = lambda p: F.filter(F.transform("rows", lambda x, i: F.when(x.rlike(p), i + 1)), lambda i: i.isNotNull())
    marked = rows.select("repo", "file", "test", "read", F.size("rows").alias("lines"), hits(java(TODO)).alias("todos"), hits(DEBUG).alias("debugs"))
    return marked.select("repo", "file", "test", "read", F.when(F.col("read"), F.col("lines")).otherwise(0).alias("lines"), F.size("todos").alias("todo"), F.get("todos", F.lit(0)).alias("first_todo"), F.size("debugs").alias("debug"), F.get("debugs", F.lit(0)).alias("first_debug"))


def code_totals(counts: DataFrame) -> DataFrame:
    """repo, files, total_lines, test_files, todos, debugs, big_files, and where marks stand first; files in the order of their paths."""
    first = lambda n: F.min(F.when(F.col(n) > 0, F.struct("file", F.col(f"first_{n}").alias("line"))))
    return counts.groupBy("repo").agg(
        F.count_if("read").alias("files"), F.sum("lines").alias("total_lines"), F.count_if("test").alias("test_files"), F.sum("todo").alias("todos"), F.sum("debug").alias("debugs"), F.count_if(F.col("lines") > LARGE_FILE).alias("big_files"), first("todo").alias("todo_at"), first("debug").alias("debug_at")
    )


def code_findings(files: DataFrame) -> DataFrame:
    """repo, rule, severity, effort, file, line, n: large files (the first five), marks of debt, traces of debugging, missing tests."""
    counts = code_counts(files)
    order = Window.partitionBy("repo").orderBy("file")
    large = counts.where(F.col("lines") > LARGE_FILE).withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST_LARGE)
    totals = code_totals(counts)
    found = [
        _finding(large, "large-file", "low", 0.5, F.col("file"), F.lit(1), F.col("lines")),
        _finding(totals.where("todos > 0"), "todo-debt", "info", F.least(F.lit(2.0), F.round(F.col("todos") * 0.1, 10)), F.col("todo_at.file"), F.col("todo_at.line"), F.col("todos")),
        _finding(totals.where("debugs > 0"), "debug-left", "low", 0.2, F.col("debug_at.file"), F.col("debug_at.line"), F.col("debugs")),
        _finding(totals.where((F.col("files") > FEW_FILES) & (F.col("test_files") == 0)), "no-tests", "medium", 1.5, F.lit("package.json"), F.lit(1), F.col("files")),
    ]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def migration_findings(files: DataFrame, found: DataFrame) -> DataFrame:
    """repo, rule, severity, effort, file, line, n of repositories that use a database and version no schema; found: repo, of the data rules' findings."""
    kept = files.where(~F.col("file").rlike(SKIPPED))
    facts = kept.groupBy("repo").agg(F.bool_or(F.col("file").rlike(SCHEMA_FILE)).alias("schema"), F.bool_or(F.col("file").rlike(MIGRATIONS)).alias("migrations"))
    facts = facts.join(found.groupBy("repo").agg(F.count("*").alias("n")), "repo", "left")
    bare = facts.where((F.col("schema") | (F.coalesce("n", F.lit(0)) > 0)) & ~F.col("migrations"))
    return _finding(bare, "no-migrations", "low", 0.5, F.lit("."), F.lit(1), F.coalesce("n", F.lit(0)))


def env_findings(files: DataFrame) -> DataFrame:
    """repo, rule, severity, effort, file, line, n of environment files that were committed, at most three folders deep, but for examples."""
    kept = files.where(F.col("file").rlike(ENV_FILE) & ~F.col("file").rlike(ENV_SAMPLE) & ~F.col("file").rlike(r"(^|/)(node_modules|\.git|dist)/") & (F.regexp_count("file", F.lit("/")) <= 3))
    return _finding(kept, "env-committed", "high", 0.3, F.col("file"), F.lit(1), F.lit(1))
