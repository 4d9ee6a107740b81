"""Rules over lines of source text: secrets, dangerous code, data access and code quality."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import entropy
from quarry.plans.expr import holds, java


@dataclass(frozen=True)
class LineRule:
    """A pattern that a line breaks; `hints` are lower-case strings of which every such line holds one."""

    id: str
    severity: str
    effort: float
    confidence: str
    find: str
    langs: tuple[str, ...] = ()
    cwe: int = 798
    hints: tuple[str, ...] = ()


# Fixed values, down to MARKER: patterns of secrets, of dangerous code, of loops, placeholders and marks, and limits.
SECRETS = (
    LineRule("stripe-secret-live", "critical", 0.5, "high", r"\bsk_live_[0-9a-zA-Z]{20,}", hints=("sk_live_",)),
    LineRule("stripe-restricted-live", "critical", 0.5, "high", r"\brk_live_[0-9a-zA-Z]{20,}", hints=("rk_live_",)),
    LineRule("aws-access-key", "critical", 0.5, "high", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", hints=("akia", "asia")),
    LineRule("google-api-key", "high", 0.4, "high", r"\bAIza[0-9A-Za-z\-_]{35}\b", hints=("aiza",)),
    LineRule("github-token", "critical", 0.4, "high", r"\b(?:ghp|gho|ghu|ghs|ghr)_[0-9A-Za-z]{36}\b|\bgithub_pat_[0-9A-Za-z_]{22,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")),
    LineRule("slack-token", "high", 0.4, "high", r"\bxox[baprs]-[0-9A-Za-z-]{10,}", hints=("xox",)),
    LineRule("sendgrid-key", "high", 0.4, "high", r"\bSG\.[0-9A-Za-z_-]{22}\.[0-9A-Za-z_-]{43}\b", hints=("sg.",)),
    LineRule("openai-key", "high", 0.4, "high", r"\bsk-(?:proj-)?[0-9A-Za-z_-]{20,}", hints=("sk-",)),
    LineRule("private-key", "critical", 0.6, "high", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----", hints=("private key",)),
    LineRule("jwt-hardcoded", "medium", 0.3, "medium", r"\beyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}", hints=("eyj",)),
    LineRule("generic-secret-assign", "medium", 0.3, "low", r"(?i)\b(?:api[_-]?key|secret|token|passwd|password|client[_-]?secret|auth[_-]?token)\b\s*[:=]\s*['\"][^'\"\s]{16,}['\"]", hints=("key", "secret", "token", "passw")),
)
CODE = (
    LineRule("js-eval", "high", 0.4, "medium", r"\beval\s*\(|new\s+Function\s*\(", ("js", "ts"), 95, hints=("eval", "function")),
    LineRule("js-inner-html", "high", 0.3, "medium", r"\.(?:inner|outer)HTML\s*(?:\+?=)\s*[A-Za-z_$]", ("js", "ts", "html"), 79, hints=("html",)),
    LineRule("react-dangerous-html", "high", 0.3, "medium", r"dangerouslySetInnerHTML\s*=\s*\{\{[^}]*\b(?!__html\s*:\s*['\"`])", ("jsx", "tsx", "js", "ts"), 79, hints=("dangerously",)),
    LineRule("js-document-write", "medium", 0.3, "medium", r"document\.write(?:ln)?\s*\(", ("js", "ts", "html"), 79, hints=("document.write",)),
    LineRule("cmd-injection", "critical", 0.5, "medium", r"\b(?:exec|execSync|spawn|spawnSync)\s*\(\s*[`'\"][^`'\"]*\$\{|\b(?:exec|execSync)\s*\([^)]*\+", ("js", "ts"), 78, hints=("exec", "spawn")),
    LineRule("sql-injection", "critical", 0.5, "medium", r"(?i)(?:SELECT|INSERT|UPDATE|DELETE|WHERE|FROM)\b[^;`'\"]*(?:`[^`]*\$\{|['\"]\s*\+\s*[A-Za-z_$])", ("js", "ts", "py", "php"), 89),
    LineRule("weak-hash", "medium", 0.3, "high", r"(?i)createHash\s*\(\s*['\"](?:md5|sha1)['\"]|hashlib\.(?:md5|sha1)\s*\(", ("js", "ts", "py"), 327, hints=("createhash", "hashlib")),
    LineRule("weak-cipher", "high", 0.4, "high", r"\bcreateCipher\s*\(|\bcreateDecipher\s*\(", ("js", "ts"), 327, hints=("cipher",)),
    LineRule("tls-disabled", "high", 0.2, "high", r"rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['\"]?0", ("js", "ts"), 295, hints=("rejectunauthorized", "reject_unauthorized")),
    LineRule("cors-wildcard", "medium", 0.2, "high", r"Access-Control-Allow-Origin['\"]?\s*[:,]\s*['\"]\*['\"]", ("js", "ts"), 942, hints=("access-control",)),
    LineRule("insecure-random", "medium", 0.3, "low", r"(?i)\b(?:token|secret|nonce|otp|password|salt|apikey|api_key)\b[^;\n]*Math\.random\s*\(", ("js", "ts"), 338, hints=("math.random",)),
    LineRule("cleartext-http", "medium", 0.2, "low", r"(?i)['\"]http://(?!localhost|127\.0\.0\.1|0\.0\.0\.0)[^'\"\s]+(?:api|auth|login|token|pay)[^'\"\s]*", ("js", "ts", "py", "php", "env"), 319, hints=("http://",)),
    LineRule("py-insecure-deser", "high", 0.4, "medium", r"\bpickle\.loads?\s*\(|\byaml\.load\s*\((?![^)]*Loader\s*=\s*yaml\.SafeLoader)", ("py",), 502, hints=("pickle", "yaml.load")),
    LineRule("py-shell-true", "high", 0.4, "medium", r"subprocess\.(?:call|run|Popen|check_output)\s*\([^)]*shell\s*=\s*True|\bos\.system\s*\(", ("py",), 78, hints=("subprocess", "os.system")),
)
DATA = (
    LineRule("select-star", "low", 0.3, "", r"(?i)\bSELECT\s+\*\s+FROM\b", hints=("select",)),
    LineRule("no-limit", "info", 0.3, "", r"(?i)\.(?:find|findAll|query)\((?![^)]*limit)[^)]*\)", hints=(".find", ".query")),
)
LOOP, AWAITED = r"for\s*\(|\.map\(|\.forEach\(", r"await\s+.*\.(?:find|query|get|findOne|select)\("
TODO, DEBUG = r"\b(?:TODO|FIXME|HACK|XXX)\b", r"console\.(?:log|debug)\(|debugger;|print\(|var_dump\("
PLACEHOLDER = r"(?i)\b(?:example|examples|xxx+|your[_-]?|changeme|change_me|placeholder|dummy|sample|redacted|fake|test[_-]?key|foo|bar|lorem|000000|123456|<[^>]+>|\.\.\.|process\.env|import\.meta|getenv)\b"
LITERAL = r"=\s*['\"`][^'\"`$]*['\"`]\s*;?\s*$"
LONGEST, LARGE_FILE = 2_000, 600
MARKER = "audit-ignore"


def lines(documents: DataFrame, file: str = "doc_id", text: str = "text", lang: str | None = None) -> DataFrame:
    """file, n (from 1), line, lang of each line; texts with a NUL byte are binary and give none."""
    some = documents.where(F.col(text).isNotNull() & ~F.contains(F.col(text), F.char(F.lit(0))))
    return some.select(F.col(file).alias("file"), (F.lit(None).cast("string") if lang is None else F.col(lang)).alias("lang"), F.posexplode(F.split(text, "\r?\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)


def unsuppressed(source: DataFrame, marker: str = MARKER) -> DataFrame:
    """Lines that neither hold the marker nor follow a line that does, and aren't too long.

    Only a line's neighbours are compared: one window over each file.
    """
    order = Window.partitionBy("file").orderBy("n")
    marked = F.contains(F.lower("line"), F.lit(marker))
    return source.withColumn("after", F.coalesce(F.lag(marked).over(order), F.lit(False))).where(~marked & ~F.col("after") & (F.length("line") <= LONGEST)).drop("after")


def matches(source: DataFrame, rules: tuple[LineRule, ...]) -> DataFrame:
    """file, n, line, rule, severity, effort, confidence, cwe, match of each rule that a line breaks: one pass for all rules.

    A rule for some languages holds for files of these and of unknown language.
    """

    def row(i: int, r: LineRule):
        pattern = java(r.find)
        spoken = (F.col("lang").isNull() | F.col("lang").isin(*r.langs)) if r.langs else F.lit(True)
        hinted = holds("low", r.hints) if r.hints else F.lit(True)
        return F.when(spoken & hinted & F.col("line").rlike(pattern), F.struct(F.lit(i).alias("seq"), F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.effort).alias("effort"), F.lit(r.confidence).alias("confidence"), F.lit(f"CWE-{r.cwe}").alias("cwe"), F.regexp_extract("line", pattern, 0).alias("match")))

    found = F.explode(F.array_compact(F.array(*[row(i, r) for i, r in enumerate(rules)])))
    hinted = source.select("file", "lang", "n", "line", F.lower("line").alias("low"))
    return hinted.select("file", "n", "line", found.alias("f")).select("file", "n", "line", "f.*")


def scan(documents: DataFrame, rules: tuple[LineRule, ...], file: str = "doc_id", text: str = "text", lang: str | None = None) -> DataFrame:
    """What `matches` finds in the lines of some texts that aren't suppressed and aren't too long.

    The line before is taken from the text itself, so no window sorts a file.
    """
    some = documents.where(F.col(text).isNotNull() & ~F.contains(F.col(text), F.char(F.lit(0))))
    parts = some.select(F.col(file).alias("file"), (F.lit(None).cast("string") if lang is None else F.col(lang)).alias("lang"), F.split(text, "\r?\n").alias("lines"), F.contains(F.lower(text), F.lit(MARKER)).alias("marked"))
    rows = parts.select("file", "lang", F.posexplode(F.when(F.col("marked"), F.transform("lines", lambda x, i: F.struct(x.alias("line"), F.get("lines", i - 1).alias("before")))).otherwise(F.transform("lines", lambda x: F.struct(x.alias("line"), F.lit(None).cast("string").alias("before"))))).alias("n", "x"))
    marked = lambda c: F.contains(F.lower(c), F.lit(MARKER))
    kept = rows.select("file", "lang", (F.col("n") + 1).alias("n"), "x.line", "x.before").where(~marked("line") & ~F.coalesce(marked("before"), F.lit(False)) & (F.length("line") <= LONGEST))
    return matches(kept, rules)


def secret_verdicts(found: DataFrame) -> DataFrame:
    """Each match with a verdict: placeholders are rejected, generic secrets need entropy, known prefixes are sure."""
    value = F.coalesce(F.nullif(F.regexp_extract("match", r"['\"]([^'\"]{12,})['\"]", 1), F.lit("")), F.col("match"))
    fake = F.col("line").rlike(java(PLACEHOLDER)) | F.col("match").rlike(java(PLACEHOLDER))
    generic = F.col("rule") == "generic-secret-assign"
    bits = F.when(generic, F.round(entropy(value), 4))
    verdict = F.when(fake, "rejected").when(generic & (entropy(value) < 3.0), "rejected").when(generic, "plausible").otherwise("confirmed")
    return found.select("*", bits.alias("bits"), verdict.alias("verdict"))


def code_verdicts(found: DataFrame) -> DataFrame:
    """Confidence decides; a medium one with a literal value is only plausible."""
    literal = F.col("line").rlike(LITERAL)
    return found.select("*", F.when(F.col("confidence") == "high", "confirmed").when((F.col("confidence") == "medium") & ~literal, "confirmed").otherwise("plausible").alias("verdict"))


def first_in_file(found: DataFrame) -> DataFrame:
    """The first line of each rule in each file."""
    return found.groupBy("file", "rule").agg(F.min("n").alias("n"))


def queries_in_loops(source: DataFrame) -> DataFrame:
    """file, n of lines that start a loop and have an awaited query on them or in the three lines after."""
    ahead = Window.partitionBy("file").orderBy("n").rowsBetween(0, 3)
    return source.withColumn("near", F.array_join(F.collect_list("line").over(ahead), "\n")).where(F.col("line").rlike(LOOP) & F.col("near").rlike(AWAITED)).select("file", "n")


def quality(source: DataFrame) -> DataFrame:
    """Per file: lines, todo, debug and whether it is large."""
    return source.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(F.col("line").rlike(java(TODO))).alias("todo"), F.count_if(F.col("line").rlike(DEBUG)).alias("debug")).withColumn("large", F.col("lines") > LARGE_FILE)
