"""The engine's operators as queries over the given tables, and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import audit, model, oracles
from quarry.functions import text as txt
from quarry.operators import audits, contrast, findings, links
from quarry.plans import dependency_rules, line_rules, page_rules, response_rules
from quarry.sinks import writers
from quarry.sources import readers
from quarry.streaming import quota

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def described(pages: DataFrame) -> DataFrame:
    """The pages with a description each: their title's words but the last, its vowels in capitals."""
    head = F.concat(F.lit('<meta name="description" content="'), F.translate(F.regexp_extract("html", "<title>([^<]*) [^ <]*</title>", 1), "aeiou", "AEIOU"), F.lit('">'))
    return pages.select("page_id", "url", F.concat(head, "html").alias("html"))


def spread(df: DataFrame) -> DataFrame:
    """A table that was just read, in as many partitions as there are cores.

    For work that is heavy for each row, where a small table has a few row
    groups only; a table with more partitions than cores is left as it is, so
    large ones aren't shuffled.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def values(name: str, columns: str, rows: str) -> tuple[str, str]:
    """A fixture that reads alike in both engines: (query, common table expression)."""
    return f"SELECT * FROM VALUES {rows} AS {name}({columns})", f"{name} AS (SELECT * FROM (VALUES {rows}) AS {name}({columns}))"


# Orders stand for findings and customers' orders for audits: the same shapes at any size.
SEVERITY_OF = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "low", "5-LOW": "info"}
_CASE = "CASE " + " ".join(f"WHEN o_orderpriority = '{k}' THEN '{v}'" for k, v in SEVERITY_OF.items()) + " END"
_AGENT = "CASE o_custkey % 15 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(model.AGENTS)) + " END"
_VERDICT = "CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'plausible' ELSE 'rejected' END"
FINDINGS = f"""SELECT o_orderkey AS seq, {_AGENT} AS agent, {_CASE} AS severity, {_VERDICT} AS verdict, CAST(o_orderkey % 20 AS DOUBLE) / 10 AS effort,
  concat('rule-', CAST(o_orderkey % 97 AS VARCHAR(9))) AS rule, concat('https://s/', CAST(o_custkey % 50 AS VARCHAR(9))) AS url,
  CASE WHEN o_orderkey % 3 = 0 THEN 'gain' ELSE 'risk' END AS kind, concat('https://s/', CAST(o_custkey % 50 AS VARCHAR(9)), '::rule-', CAST(o_orderkey % 97 AS VARCHAR(9))) AS loc_key, o_orderdate < TIMESTAMP '1998-01-01' AS early FROM orders"""
_RANK = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in model.SEVERITY.items()) + " ELSE 0 END"
_WEIGHT = "CASE agent " + " ".join(f"WHEN '{k}' THEN {v[2]}" for k, v in model.AGENTS.items()) + " ELSE 1.0 END"
_CONF = "CASE verdict WHEN 'confirmed' THEN 1.0 WHEN 'plausible' THEN 0.6 ELSE 0.0 END"
_PRIORITY = f"CAST(floor(CAST({_RANK} AS DOUBLE) * {_RANK} * CAST({_WEIGHT} AS DOUBLE) * CAST({_CONF} AS DOUBLE) / greatest(CAST(0.1 AS DOUBLE), effort) * 10 + 0.5) AS BIGINT)"
_F = f"WITH f AS ({FINDINGS}) "


def order_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = findings.literal_map(SEVERITY_OF)[F.col("o_orderpriority")]
    agent = findings.literal_map(dict(enumerate(model.AGENTS)))[(F.col("o_custkey") % 15).cast("int")]
    verdict = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "plausible").otherwise("rejected")
    rule = F.concat(F.lit("rule-"), (F.col("o_orderkey") % 97).cast("string"))
    url = F.concat(F.lit("https://s/"), (F.col("o_custkey") % 50).cast("string"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "gain").otherwise("risk")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), agent.alias("agent"), severity.alias("severity"), verdict.alias("verdict"), ((F.col("o_orderkey") % 20).cast("double") / 10).alias("effort"), rule.alias("rule"), url.alias("url"), kind.alias("kind"), F.concat(url, F.lit("::"), rule).alias("loc_key"), (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("early"))


def order_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("target"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.floor(F.col("o_totalprice") % 100).cast("int").alias("score"))


AUDITS = "a AS (SELECT o_custkey AS target, o_orderkey AS id, o_orderdate AS made, CAST(floor(o_totalprice % 100) AS INTEGER) AS score FROM orders)"

# Pages.


def _page_query(agent: str):
    def run(spark, sf_dir):
        return page_rules.verdicts(spread(table(spark, sf_dir, "pages")), agent)

    run.__name__ = f"{agent}_page_rules"
    return run


for _agent in page_rules.AGENTS:
    query(oracles.page_verdicts(_agent))(_page_query(_agent))


@query(f"WITH {oracles.FACTS} SELECT page_id, title, descr, h1, canonical, noindex, words, length(text) AS text_chars FROM known")
def page_facts(spark, sf_dir):
    return page_rules.page_facts(table(spark, sf_dir, "pages")).select("page_id", "title", "descr", "h1", "canonical", "noindex", "words", F.length("text").alias("text_chars"))


@query(f"SELECT agent, rule, severity, count(*) AS n FROM ({oracles.page_findings()}) GROUP BY ALL")
def page_rule_counts(spark, sf_dir):
    return page_rules.findings(spread(table(spark, sf_dir, "pages"))).groupBy("agent", "rule", "severity").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, agent, rule, severity, {_RANK} AS rank, {_PRIORITY} AS priority FROM ({oracles.page_findings()})")
def page_findings_ranked(spark, sf_dir):
    found = audit.page_findings(spread(table(spark, sf_dir, "pages")))
    return findings.ranked(found).select("page_id", "agent", "rule", "severity", "rank", "priority")


def _repeated(value: str) -> str:
    return f"""WITH {oracles.FACTS} SELECT lower({value}) AS value, count(*) AS n, min(page_id) AS first_page, arg_min({value}, page_id) AS spelled, array_to_string(list_sort(list(page_id))[:8], ',') AS pages
      FROM known WHERE {value} IS NOT NULL GROUP BY 1 HAVING count(*) > 1"""


@query(_repeated("title"))
def duplicate_titles(spark, sf_dir):
    return links.duplicates(page_rules.page_facts(table(spark, sf_dir, "pages")), "title")


@query(_repeated("descr").replace("FROM pages)", "FROM (SELECT page_id, url, concat('<meta name=\"description\" content=\"', translate(regexp_extract(html, '<title>([^<]*) [^ <]*</title>', 1), 'aeiou', 'AEIOU'), '\">', html) AS html FROM pages))"))
def duplicate_descriptions(spark, sf_dir):
    """The pages as if each told its title, without its last word, as its description."""
    return links.duplicates(page_rules.page_facts(described(table(spark, sf_dir, "pages"))), "descr")


LINKS_SQL = r"""
  raw AS (SELECT url, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a\b[^>]*\bhref\s*=\s*["'']([^"'']+)["'']', 1)) AS href FROM pages),
  own AS (SELECT url, href, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin FROM raw),
  abs AS (SELECT url, origin, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^([^:]+:)', 1) || href WHEN href LIKE '/%' THEN origin || href WHEN href LIKE '#%' THEN url WHEN href LIKE '?%' THEN regexp_extract(url, '^([^?#]*)', 1) || href ELSE origin || coalesce(nullif(regexp_extract(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '^(.*/)', 1), ''), '/') || href END AS full_url FROM own),
  cut AS (SELECT url, origin, regexp_replace(full_url, '#.*$', '') AS u FROM abs),
  edges AS (SELECT DISTINCT url AS src, origin || coalesce(nullif(regexp_replace(regexp_extract(u, '^[^:]+://[^/?#]*([^?]*)', 1), '/+$', ''), ''), '/') || regexp_extract(u, '(\?.+)$', 1) AS dst FROM cut WHERE regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) = origin AND regexp_matches(origin, '(?i)^https?://') AND NOT regexp_matches(regexp_extract(u, '^[^:]+://[^/?#]*([^?]*)', 1), '(?i)\.(png|jpe?g|gif|webp|avif|svg|ico|css|js|mjs|json|xml|txt|pdf|zip|woff2?|ttf|eot|mp4|webm|mp3|map)(\?|$)'))
"""


@query(f"WITH {LINKS_SQL} SELECT src, dst FROM edges")
def internal_links(spark, sf_dir):
    return links.links(table(spark, sf_dir, "pages"))


@query(
    f"""WITH {LINKS_SQL}, plain AS (SELECT regexp_replace(url, '#.*$', '') AS u, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin FROM pages),
    known AS (SELECT DISTINCT origin || coalesce(nullif(regexp_replace(regexp_extract(u, '^[^:]+://[^/?#]*([^?]*)', 1), '/+$', ''), ''), '/') || regexp_extract(u, '(\\?.+)$', 1) AS dst FROM plain)
    SELECT dst, count(DISTINCT src) AS sources FROM edges WHERE dst NOT IN (SELECT dst FROM known) GROUP BY dst"""
)
def broken_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return links.broken(links.links(pages), pages)


@query(
    f"""WITH RECURSIVE {LINKS_SQL}, plain AS (SELECT regexp_replace(url, '#.*$', '') AS u, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin FROM pages),
    named AS (SELECT url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || coalesce(nullif(regexp_replace(regexp_extract(regexp_replace(url, '#.*$', ''), '^[^:]+://[^/?#]*([^?]*)', 1), '/+$', ''), ''), '/') || regexp_extract(regexp_replace(url, '#.*$', ''), '(\\?.+)$', 1) AS name, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin FROM pages WHERE regexp_matches(url, '(?i)^https?://')
      AND NOT regexp_matches(regexp_extract(regexp_replace(url, '#.*$', ''), '^[^:]+://[^/?#]*([^?]*)', 1), '(?i)\\.(png|jpe?g|gif|webp|avif|svg|ico|css|js|mjs|json|xml|txt|pdf|zip|woff2?|ttf|eot|mp4|webm|mp3|map)(\\?|$)')),
    home AS (SELECT arg_min(name, (length(name), name)) AS url FROM named GROUP BY origin), walk AS (SELECT DISTINCT name AS src, dst FROM edges JOIN named ON src = url),
    reach AS (SELECT url, 0 AS depth FROM home UNION SELECT e.dst, r.depth + 1 FROM reach r JOIN walk e ON e.src = r.url WHERE r.depth < 40)
    SELECT url, min(depth) AS depth FROM reach GROUP BY url"""
)
def crawl_frontier(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    found = links.links(pages)
    named = found.select(links.normal(F.col("src"), links.origin(F.col("src"))).alias("src"), "dst").where("src is not null")
    return links.crawl(named, links.homes(pages))


_TARGETS, _TARGETS_CTE = values("t", "raw", "('example.com'), ('http://localhost/x'), ('ftp://a.b'), ('10.0.0.1'), ('172.20.1.1:80'), ('172.32.1.1'), ('https://[::1]/'), ('a.internal'), (''), ('https://user@192.168.1.1/p'), ('HTTPS://Example.ORG/a?b'), ('169.254.169.254')")
_GUARD = r"""SELECT raw, host, CASE WHEN txt = '' OR host = '' THEN 'empty' WHEN NOT regexp_matches(txt, '(?i)^https?://') THEN 'scheme'
  WHEN regexp_matches(host, '(?i)^(localhost|.*\.localhost|.*\.local|.*\.internal|ip6-localhost)$') OR regexp_matches(host, '^(10|127|0)\.\d{1,3}\.\d{1,3}\.\d{1,3}$|^169\.254\.\d{1,3}\.\d{1,3}$|^172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}$|^192\.168\.\d{1,3}\.\d{1,3}$|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.\d{1,3}\.\d{1,3}$') OR regexp_matches(host, '(?i)^\[?(::1?\]?$|fe80:|fc|fd)') THEN 'host' ELSE 'ok' END AS verdict
  FROM (SELECT raw, txt, lower(regexp_extract(txt, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1)) AS host FROM (SELECT raw, CASE WHEN trim(raw) = '' THEN '' WHEN regexp_matches(trim(raw), '(?i)^[a-z][a-z0-9+.-]*://') THEN trim(raw) ELSE 'https://' || trim(raw) END AS txt FROM """


@query(f"WITH {_TARGETS_CTE} {_GUARD} t))")
def target_guard(spark, sf_dir):
    host, verdict = txt.target(F.col("raw"))
    return spark.sql(_TARGETS).select("raw", host.alias("host"), verdict.alias("verdict"))


@query(f"{_GUARD} (SELECT url AS raw FROM pages)))")
def page_targets(spark, sf_dir):
    host, verdict = txt.target(F.col("raw"))
    return table(spark, sf_dir, "pages").select(F.col("url").alias("raw")).select("raw", host.alias("host"), verdict.alias("verdict"))


# Lines of source text.

_LINES = "lines AS (SELECT doc_id AS file, CAST(NULL AS VARCHAR) AS lang, generate_subscripts(parts, 1) AS n, unnest(parts) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS parts FROM documents WHERE text IS NOT NULL))"


@query(f"WITH {_LINES}, {oracles.suppressed('lines')} {oracles.line_findings('kept', oracles.SECRET_LINES)}")
def secret_lines(spark, sf_dir):
    return line_rules.scan(spread(table(spark, sf_dir, "documents")), line_rules.SECRETS).select("file", "n", "rule", "severity")


@query(
    rf"""WITH {_LINES}, m AS (SELECT file, n, line, regexp_extract(line, {oracles.quoted(oracles.SECRET_LINES.strip().splitlines()[-1].split(' | ')[-1])}) AS match FROM lines WHERE regexp_matches(line, {oracles.quoted(oracles.SECRET_LINES.strip().splitlines()[-1].split(' | ')[-1])})),
    v AS (SELECT *, coalesce(nullif(regexp_extract(match, '[''"]([^''"]{{12,}})[''"]', 1), ''), match) AS val FROM m),
    h AS (SELECT *, (SELECT -sum(c * 1.0 / length(val) * log2(c * 1.0 / length(val))) FROM (SELECT ch, count(*) AS c FROM (SELECT unnest(string_split(val, '')) AS ch) GROUP BY ch)) AS e FROM v)
    SELECT file, n, 'generic-secret-assign' AS rule, round(e, 4) AS bits, CASE WHEN regexp_matches(line, {oracles.quoted(line_rules.PLACEHOLDER)}) THEN 'rejected' WHEN e < 3.0 THEN 'rejected' ELSE 'plausible' END AS verdict FROM h"""
)
def secret_verdicts(spark, sf_dir):
    source = line_rules.lines(spread(table(spark, sf_dir, "documents")))
    return line_rules.secret_verdicts(line_rules.matches(source, line_rules.SECRETS[-1:])).select("file", "n", "rule", "bits", "verdict")


@query(f"WITH {_LINES} SELECT file, count(*) AS lines, count(*) FILTER (regexp_matches(line, {oracles.quoted(line_rules.TODO)})) AS todo, count(*) FILTER (regexp_matches(line, {oracles.quoted(line_rules.DEBUG)})) AS debug, count(*) > 600 AS large FROM lines GROUP BY file")
def code_quality(spark, sf_dir):
    return line_rules.quality(line_rules.lines(spread(table(spark, sf_dir, "documents"))))


_CODE_ROWS = r"""('a.js','js',1,'eval(x)'), ('a.js','js',2,'el.innerHTML = name'), ('a.js','js',3,'el.innerHTML = "x"'), ('a.js','js',4,'exec("ls " + p)'), ('a.js','js',5,'// audit-ignore'), ('a.js','js',6,'eval(y)'),
 ('a.js','js',7,'rejectUnauthorized: false'), ('a.js','js',8,'crypto.createHash("md5")'), ('a.js','js',9,'const token = Math.random()'), ('b.py','py',1,'yaml.load(f)'), ('b.py','py',2,'yaml.load(f, Loader=yaml.SafeLoader)'),
 ('b.py','py',3,'subprocess.run(c, shell=True)'), ('b.py','py',4,'q = "SELECT * FROM t WHERE a=" + x'), ('b.py','py',5,'fetch("http://localhost/api")'), ('b.py','py',6,'fetch("http://h.io/api")'), ('e.js','js',1,'new  Function ("a")'), ('e.js','js',2,'evaluate(x)'), ('e.js','js',3,'document.writeln (x)'), ('e.js','js',4,'document.written(x)'), ('e.js','js',5,'crypto.createCipher("aes", k)'), ('e.js','js',6,'createCipheriv("aes", k)'),
 ('e.js','js',7,'h["Access-Control-Allow-Origin"] = 1; x = {"Access-Control-Allow-Origin": "*"}'), ('e.js','js',8,'"Access-Control-Allow-Origin": "https://a.io"'), ('e.js','js',9,'<p dangerouslySetInnerHTML={{ __html: x }} />'), ('e.js','js',10,'<p dangerouslySetInnerHTML={{ }} />'), ('e.js','js',11,'const n = Math.random()'),
 ('e.js','js',12,concat('spawn(`rm $', '{x}`)')), ('e.js','js',13,'const h = crypto.createHash("sha256")'), ('e.py','py',1,'hashlib.sha1 (x)'), ('e.py','py',2,'os.system (c)'), ('e.py','py',3,'subprocess.run(c)'), ('e.py','py',4,'eval(x)'), ('e.py','py',5,'pickle.load(f)'), ('e.py','py',6,'q = "SELECT a FROM t"'), ('e.py','py',7,'fetch("http://0.0.0.0/login")'),
 ('f.sql',NULL,1,'NODE_TLS_REJECT_UNAUTHORIZED=0'), ('f.sql',NULL,2,'rejectUnauthorized: true'), ('f.sql',NULL,3,'el.outerHTML += y'), ('f.sql',NULL,4,'xinnerHTML = y'), ('c.yml',NULL,1,'eval(z)'), ('c.yml',NULL,2,'pickle.loads(b)'),
 ('d.js','js',7,'SELECT  * FROM t'), ('d.js','js',8,'db.findAll(x)'), ('d.js','js',9,'db.find(limit)'), ('d.js','js',1,'for (const u of us) {'), ('d.js','js',2,'  const a = 1'), ('d.js','js',3,'  await db.find(u)'), ('d.js','js',4,'}'), ('d.js','js',5,'await db.query({limit: 5})'), ('d.js','js',6,'us.map(f)')"""
_CODE, _CODE_CTE = values("code", "file, lang, n, line", _CODE_ROWS)


@query(f"WITH {_CODE_CTE}, {oracles.suppressed('code')} {oracles.line_findings('kept', oracles.CODE_LINES)}")
def sast_lines(spark, sf_dir):
    return line_rules.matches(line_rules.unsuppressed(spark.sql(_CODE)), line_rules.CODE).select("file", "n", "rule", "severity")


@query(f"WITH {_CODE_CTE}, m AS (SELECT *, lag(contains(lower(line), 'audit-ignore')) OVER (PARTITION BY file ORDER BY n) AS after FROM code) SELECT file, n, line FROM m WHERE NOT contains(lower(line), 'audit-ignore') AND NOT coalesce(after, false) AND length(line) <= 2000")
def unsuppressed_lines(spark, sf_dir):
    return line_rules.unsuppressed(spark.sql(_CODE)).select("file", "n", "line")


@query(f"WITH {_CODE_CTE}, m AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY file ORDER BY n ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS near FROM code) SELECT file, n FROM m WHERE regexp_matches(line, {oracles.quoted(line_rules.LOOP)}) AND regexp_matches(near, {oracles.quoted(line_rules.AWAITED)})")
def n_plus_one(spark, sf_dir):
    return line_rules.queries_in_loops(spark.sql(_CODE))


@query(f"WITH {_CODE_CTE}, m AS ({oracles.line_findings('code', oracles.DATA_LINES)}) SELECT file, rule, min(n) AS n FROM m GROUP BY file, rule")
def data_rules(spark, sf_dir):
    return line_rules.first_in_file(line_rules.matches(spark.sql(_CODE), line_rules.DATA))


# Findings.


@query(_F + "SELECT s.severity, count(f.seq) AS n FROM (VALUES ('critical'),('high'),('medium'),('low'),('info')) s(severity) LEFT JOIN f ON f.severity = s.severity GROUP BY s.severity")
def severity_counts(spark, sf_dir):
    return findings.by_severity(order_findings(spark, sf_dir))


@query(_F + f"SELECT seq, {_PRIORITY} AS priority FROM f")
def priority_score(spark, sf_dir):
    return order_findings(spark, sf_dir).select("seq", findings.priority().alias("priority"))


_DIM = "d(agent, agent_n, weight) AS (VALUES " + ", ".join(f"('{a}', {v[0]}, CAST({v[2]} AS DOUBLE))" for a, v in model.AGENTS.items()) + ")"
_DOMAINS = f"""WITH {_DIM}, f AS ({FINDINGS}), s AS (SELECT agent, count(*) AS n, sum(CASE WHEN verdict <> 'rejected' THEN {_RANK} * {_RANK} ELSE 0 END) AS p, max({_RANK}) AS worst FROM f GROUP BY agent),
 g AS (SELECT d.agent, d.agent_n, d.weight, coalesce(n, 0) AS n, coalesce(worst, 0) AS worst, d.agent NOT IN ('deps', 'code-arch', 'data') AS evaluated, CASE WHEN d.agent NOT IN ('deps', 'code-arch', 'data') THEN CAST(greatest(0, floor(100 - 100 * CAST(coalesce(p, 0) AS DOUBLE) / (coalesce(p, 0) + 40) + 0.5)) AS BIGINT) END AS score FROM d LEFT JOIN s ON s.agent = d.agent)"""


@query(_DOMAINS + " SELECT * FROM g")
def domain_scores(spark, sf_dir):
    return findings.domain_scores(order_findings(spark, sf_dir))


@query(_DOMAINS + " SELECT CAST(floor(sum(score * weight) / sum(weight) + 0.5) AS BIGINT) AS weighted_score, arg_max(agent, score * 100 - agent_n) AS strongest, arg_min(agent, score * 100 + agent_n) AS weakest FROM g WHERE evaluated")
def weighted_score(spark, sf_dir):
    return findings.weighted_score(findings.domain_scores(order_findings(spark, sf_dir)))


@query(_F + f", p AS (SELECT sum(CAST({_WEIGHT} AS DOUBLE) * {_RANK} * {_RANK}) AS p FROM f WHERE verdict <> 'rejected') SELECT CAST(greatest(0, floor(100 - 100 * p / (p + 120) + 0.5)) AS BIGINT) AS health FROM p")
def health_score(spark, sf_dir):
    return findings.health(order_findings(spark, sf_dir))


_LOW = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in model.SEVERITY.items()) + " END"
_HIGH = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v[2]}" for k, v in model.SEVERITY.items()) + " END"


@query(_F + f"SELECT kind, 'severity' AS basis, CAST(sum({_LOW}) AS BIGINT) AS low, CAST(sum({_HIGH}) AS BIGINT) AS high, count(*) AS n FROM f GROUP BY kind")
def business_range(spark, sf_dir):
    return findings.business_totals(order_findings(spark, sf_dir))


_CONV = lambda i: "CASE severity " + " ".join(f"WHEN '{k}' THEN CAST({v[i]} AS DOUBLE)" for k, v in model.SEVERITY.items()) + " END"


@query(_F + f", c AS (SELECT *, agent IN ({', '.join(repr(a) for a in model.CONVERSION_AGENTS)}) AS acts FROM f) SELECT kind, CASE WHEN acts THEN 'calibrated' ELSE 'severity' END AS basis, CAST(sum(CASE WHEN acts THEN floor({_CONV(3)} * 120000.0 + 0.5) ELSE {_LOW} END) AS BIGINT) AS low, CAST(sum(CASE WHEN acts THEN floor({_CONV(4)} * 120000.0 + 0.5) ELSE {_HIGH} END) AS BIGINT) AS high, count(*) AS n FROM c GROUP BY ALL")
def business_calibrated(spark, sf_dir):
    return findings.business_totals(order_findings(spark, sf_dir), visits=10000.0, value=50.0, rate=0.02)


@query(_F + "SELECT CASE severity WHEN 'critical' THEN 'now' WHEN 'high' THEN 'week' WHEN 'medium' THEN 'month' ELSE 'backlog' END AS bucket, count(*) AS n, round(sum(effort), 1) AS effort_days FROM f GROUP BY 1")
def roadmap(spark, sf_dir):
    return findings.roadmap(order_findings(spark, sf_dir))


@query(_F + f"SELECT seq, severity, {_RANK} AS rank, {_PRIORITY} AS priority FROM f ORDER BY 3 DESC, 4 DESC, 1 LIMIT 10")
def top_findings(spark, sf_dir):
    return findings.top(order_findings(spark, sf_dir)).select("seq", "severity", "rank", "priority")


@query(_F + f"SELECT seq, severity, effort FROM f WHERE effort <= 0.25 ORDER BY {_RANK} DESC, {_PRIORITY} DESC, seq LIMIT 10")
def quick_wins(spark, sf_dir):
    return findings.quick_wins(order_findings(spark, sf_dir)).select("seq", "severity", "effort")


@query(_F + f"SELECT seq, concat('[audit] ', rule) AS summary, CASE severity WHEN 'critical' THEN 'Highest' ELSE 'High' END AS priority, concat('audit,', severity, ',', agent) AS labels FROM f WHERE {_RANK} >= 4 ORDER BY {_RANK} DESC, {_PRIORITY} DESC, seq LIMIT 15")
def ticket_targets(spark, sf_dir):
    from quarry.sinks.writers import tickets

    return tickets(order_findings(spark, sf_dir))


@query(
    _F
    + f""", a AS (SELECT loc_key, agent, min(seq) AS s FROM f GROUP BY ALL), r AS (SELECT loc_key, string_agg(agent, ',' ORDER BY s) AS raised_by FROM a GROUP BY loc_key),
    m AS (SELECT loc_key, min(seq) AS seq, arg_min(agent, seq) AS agent, arg_max(severity, {_RANK}) AS severity, arg_min(effort, seq) AS effort, arg_min(verdict, seq) AS verdict, count(*) AS merged FROM f GROUP BY loc_key)
    SELECT m.loc_key, seq, agent, severity, effort, verdict, raised_by, merged FROM m JOIN r ON m.loc_key = r.loc_key"""
)
def dedup_merge(spark, sf_dir):
    return findings.merge(order_findings(spark, sf_dir))


@query("SELECT agent, round(100 * weight / sum(weight) OVER (), 2) AS share FROM (VALUES " + ", ".join(f"('{a}', CAST({v[2]} AS DOUBLE))" for a, v in model.AGENTS.items()) + ") d(agent, weight)")
def weight_shares(spark, sf_dir):
    return findings.weight_shares(spark)


@query(_F + "SELECT agent, count(*) AS n, count(*) FILTER (verdict = 'rejected') AS rejected, count(*) FILTER (severity IN ('critical', 'high')) AS serious FROM f GROUP BY agent")
def agent_counts(spark, sf_dir):
    return order_findings(spark, sf_dir).groupBy("agent").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "rejected").alias("rejected"), F.count_if(F.col("severity").isin("critical", "high")).alias("serious"))


@query(f"WITH f AS ({FINDINGS}), x AS (SELECT concat(upper(left(agent, 3)), '-') AS prefix, concat(rule, ':', url, ':0') AS k, seq FROM f) SELECT seq, concat(prefix, k) AS plain, length(k) AS chars FROM x")
def finding_keys(spark, sf_dir):
    key = F.concat("rule", F.lit(":"), "url", F.lit(":0"))
    return order_findings(spark, sf_dir).select("seq", F.concat(F.upper(F.substring("agent", 1, 3)), F.lit("-"), key).alias("plain"), F.length(key).alias("chars"))


_HASH = "list_reduce(list_concat([CAST(5381 AS BIGINT)], list_transform(string_split(concat(rule, ':', url, ':0'), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (h * 33 + c) & 4294967295)"


@query(_F + f"""SELECT seq, concat(upper(left(agent, 3)), '-', ltrim(array_to_string(list_transform([6, 5, 4, 3, 2, 1, 0], lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((h // CAST(pow(36, i) AS BIGINT)) % 36 AS INTEGER) + 1, 1)), ''), '0')) AS id FROM (SELECT *, {_HASH} AS h FROM f)""")
def finding_ids(spark, sf_dir):
    return order_findings(spark, sf_dir).select("seq", txt.finding_id(F.col("agent"), F.col("rule"), F.col("url"), F.lit(None).cast("int")).alias("id"))


@query(
    f"""WITH f AS ({FINDINGS}), g AS (SELECT CASE WHEN kind = 'gain' THEN 'general' ELSE url END AS file, seq, severity, rule AS fix, {_RANK} AS r FROM f WHERE verdict <> 'rejected')
    SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY r DESC, seq) AS INTEGER) AS place, count(*) OVER (PARTITION BY file) AS n, severity, fix FROM g"""
)
def fix_bundle_by_file(spark, sf_dir):
    f = order_findings(spark, sf_dir)
    return audits.fixes_by_file(f.withColumn("file", F.when(F.col("kind") != "gain", F.col("url"))).withColumn("fix", F.col("rule")))


# Audits over time.


@query(f"WITH {AUDITS} SELECT target, id, score, CAST(row_number() OVER (PARTITION BY target ORDER BY made DESC, id DESC) AS INTEGER) AS place FROM a QUALIFY row_number() OVER (PARTITION BY target ORDER BY made DESC, id DESC) <= 5")
def audit_history(spark, sf_dir):
    return audits.history(order_audits(spark, sf_dir), 5).select("target", "id", "score", "place")


@query(f"WITH {AUDITS}, l AS (SELECT target, id, score, lag(score) OVER (PARTITION BY target ORDER BY made, id) AS previous FROM a) SELECT *, score - previous AS delta, CASE WHEN previous IS NULL THEN 'baseline' WHEN score - previous < -3 THEN 'regression' WHEN score - previous > 3 THEN 'improvement' ELSE 'stable' END AS verdict FROM l")
def score_trend(spark, sf_dir):
    return audits.trend(order_audits(spark, sf_dir))


@query(_F + ", p AS (SELECT concat(loc_key, agent) AS key, severity, seq FROM f WHERE early), c AS (SELECT concat(loc_key, agent) AS key, severity, seq FROM f WHERE NOT early), a AS (SELECT key, arg_max(severity, seq) AS before FROM p GROUP BY key), b AS (SELECT key, arg_max(severity, seq) AS after FROM c GROUP BY key) SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'resolved' ELSE 'persisting' END AS status, coalesce(after, before) AS severity, a.key IS NULL AND coalesce(after, before) IN ('critical', 'high', 'medium') AS regression, b.key IS NULL AND before IN ('critical', 'high', 'medium') AS fixed FROM a FULL JOIN b ON a.key = b.key")
def findings_diff(spark, sf_dir):
    f = order_findings(spark, sf_dir).withColumn("key", F.concat("loc_key", "agent"))
    return audits.difference(f.where("early"), f.where("not early"))


@query("WITH s AS (SELECT o_custkey % 100 AS target, o_orderpriority AS domain, CAST(o_orderdate AS DATE) AS made, CAST(max(floor(o_totalprice % 100)) AS INTEGER) AS score FROM orders GROUP BY ALL), l AS (SELECT *, lag(score) OVER (PARTITION BY target, domain ORDER BY made) AS before, max(made) OVER (PARTITION BY target) AS newest FROM s) SELECT target, domain, before, score AS after, score - before AS delta, CAST(row_number() OVER (PARTITION BY target ORDER BY score - before, domain) AS INTEGER) AS place FROM l WHERE made = newest AND before <> score")
def domain_deltas(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 100).alias("target"), F.col("o_orderpriority").alias("domain"), F.to_date("o_orderdate").alias("at")).agg(F.max(F.floor(F.col("o_totalprice") % 100)).cast("int").alias("score"))
    return audits.domain_changes(s)


@query("SELECT o_orderkey AS finding_id, o_custkey AS audit_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def tenant_rows(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id"), F.col("o_custkey").alias("audit_id"))
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("audit_id"), F.col("c_mktsegment").alias("tenant"))
    return audits.of_tenant(f, a, "BUILDING")


@query("WITH m AS (SELECT c_mktsegment AS tenant, c_nationkey AS email, c_name AS role, c_custkey AS seq FROM customer) SELECT tenant, email, arg_max(role, seq) AS role, max(seq) AS seq FROM m GROUP BY tenant, email")
def member_upsert(spark, sf_dir):
    m = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("tenant"), F.col("c_nationkey").alias("email"), F.col("c_name").alias("role"), F.col("c_custkey").alias("seq"), (F.col("c_acctbal") >= 0).alias("old"))
    return audits.upsert(m.where("old").drop("old"), m.where("not old").drop("old"))


_KEYS, _KEYS_CTE = values("keys", "api_key, tenant, role", "('pk_a', 'acme', 'member'), ('pk_b', 'beta', 'owner')")
_REQ, _REQ_CTE = values("req", "request_id, api_key", "(1, 'pk_a'), (2, 'pk_b'), (3, CAST(NULL AS VARCHAR(9)))")


@query(f"WITH {_KEYS_CTE}, {_REQ_CTE} SELECT request_id, CASE WHEN req.api_key IS NULL THEN 'public' ELSE tenant END AS tenant, CASE WHEN req.api_key IS NULL THEN 'viewer' ELSE role END AS role FROM req LEFT JOIN keys ON req.api_key = keys.api_key")
def key_roles(spark, sf_dir):
    return audits.key_roles(spark.sql(_REQ), spark.sql(_KEYS))


_LOC, _LOC_CTE = values("loc", "file, key", "('fr', 'a.b'), ('fr', 'a.c'), ('fr', 'x'), ('en', 'a.b'), ('en', 'y'), ('de', 'a.b')")


@query(f"WITH {_LOC_CTE}, x AS (SELECT f.file, k.key FROM (SELECT DISTINCT file FROM loc) f, (SELECT DISTINCT key FROM loc) k EXCEPT SELECT file, key FROM loc) SELECT file, count(*) AS missing, string_agg(key, ',' ORDER BY key) AS keys FROM x GROUP BY file")
def i18n_missing_keys(spark, sf_dir):
    return audits.missing_translations(spark.sql(_LOC))


# Answers of servers.

_RESP_ROWS = [
    ("https://a.io/", {"content-security-policy": "default-src 'self'; script-src * 'unsafe-inline'", "strict-transport-security": "max-age=300", "server": "nginx/1.2", "content-encoding": "br", "cache-control": "max-age=60"}),
    ("http://b.io/", {"x-powered-by": "Express", "access-control-allow-origin": "*", "access-control-allow-credentials": "true", "cache-control": "no-store"}),
    ("https://c.io/", {"content-security-policy": "img-src x; frame-ancestors 'none'", "strict-transport-security": "max-age=0", "x-content-type-options": "nosniff", "referrer-policy": "no-referrer", "permissions-policy": "camera=()", "server": "cloudflare"}),
]


def _responses(spark):
    return spark.createDataFrame([(u, h, "<div data-v-1a2b3c4d>", None) for u, h in _RESP_ROWS], "url string, headers map<string,string>, body string, probe_origin string")


def _rule_rows(rows):
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows) + ")"


_LONG = ", ".join(f"({oracles.quoted(u)}, {oracles.quoted(k)}, {oracles.quoted(v)})" for u, h in _RESP_ROWS for k, v in h.items())
_RESP_CTE = f"h(url, k, v) AS (VALUES {_LONG}), u AS (SELECT DISTINCT url FROM h), r AS (SELECT url, " + ", ".join(f"coalesce((SELECT max(v) FROM h WHERE h.url = u.url AND k = '{k}'), '') AS \"{k}\"" for k in sorted({k for _, h in _RESP_ROWS for k in h} | {"x-frame-options"})) + " FROM u)"
_MISSING = " UNION ALL ".join(f"SELECT url, '{n}' AS rule FROM r WHERE \"{h}\" = ''" + (" AND url LIKE 'https://%'" if n == "missing-hsts" else " AND NOT contains(\"content-security-policy\", 'frame-ancestors')" if n == "missing-frame" else "") for n, h in response_rules.HEADERS)


@query(f"""WITH {_RESP_CTE} {_MISSING} UNION ALL SELECT url, 'server-version' FROM r WHERE regexp_matches(server, '\\d') UNION ALL SELECT url, 'powered-by' FROM r WHERE "x-powered-by" <> '' UNION ALL SELECT url, 'no-tls' FROM r WHERE url NOT LIKE 'https://%'
 UNION ALL SELECT url, 'no-compression' FROM r WHERE NOT regexp_matches("content-encoding", '(?i)gzip|br|zstd') UNION ALL SELECT url, 'weak-cache' FROM r WHERE "cache-control" = '' OR regexp_matches("cache-control", '(?i)no-store|no-cache')""")
def header_rules(spark, sf_dir):
    return response_rules.header_findings(_responses(spark))


@query(
    f"""WITH {_RESP_CTE}, c AS (SELECT *, "content-security-policy" AS csp, "strict-transport-security" AS hsts, coalesce(TRY_CAST(nullif(regexp_extract("strict-transport-security", '(?i)max-age=(\\d+)', 1), '') AS BIGINT), 0) AS age FROM r)
    SELECT url, 'csp-no-default-src' AS rule FROM c WHERE csp <> '' AND NOT regexp_matches(csp, '(?i)(^|;)\\s*default-src') UNION ALL SELECT url, 'csp-unsafe-inline' FROM c WHERE contains(csp, '''unsafe-inline''') UNION ALL SELECT url, 'csp-unsafe-eval' FROM c WHERE contains(csp, '''unsafe-eval''')
    UNION ALL SELECT url, 'csp-wildcard' FROM c WHERE regexp_matches(csp, 'script-src[^;]*\\*([^.]|$)') OR regexp_matches(csp, 'default-src[^;]*\\s\\*(\\s|;|$)') UNION ALL SELECT url, 'hsts-short-maxage' FROM c WHERE url LIKE 'https://%' AND hsts <> '' AND age > 0 AND age < 15768000
    UNION ALL SELECT url, 'hsts-no-subdomains' FROM c WHERE url LIKE 'https://%' AND hsts <> '' AND NOT (age > 0 AND age < 15768000) AND NOT regexp_matches(hsts, '(?i)includesubdomains') UNION ALL SELECT url, 'cors-reflected-origin' FROM c WHERE "access-control-allow-origin" = '*' AND lower("access-control-allow-credentials") = 'true'"""
)
def policy_rules(spark, sf_dir):
    return response_rules.policy_findings(_responses(spark))


_COOK, _COOK_CTE = values("cook", "url, cookie", "('https://a', 'sid=1; HttpOnly; Secure; SameSite=Lax'), ('https://a', '_ga=2; Secure'), ('http://a', 't=3; httponly')")


@query(f"WITH {_COOK_CTE} SELECT url, regexp_extract(cookie, '^([^=]*)', 1) AS cookie, concat_ws('/', CASE WHEN url LIKE 'https://%' AND NOT contains(lower(cookie), 'secure') THEN 'Secure' END, CASE WHEN NOT contains(lower(cookie), 'httponly') THEN 'HttpOnly' END, CASE WHEN NOT contains(lower(cookie), 'samesite') THEN 'SameSite' END) AS missing, regexp_matches(cookie, '(?i)_ga|_gid|_fbp|_gcl|hjSession|amplitude|mp_') AS tracking FROM cook")
def cookie_rules(spark, sf_dir):
    return response_rules.cookie_findings(spark.sql(_COOK))


_PROBE, _PROBE_CTE = values("probe", "base, path, status, body", "('https://a', '/.env', 200, 'DB_PASS=x'), ('https://a', '/.git/HEAD', 200, 'ref: refs/heads/main'), ('https://a', '/config.json', 404, '{}'), ('https://a', '/backup.sql', 200, 'hello')")


@query(f"WITH {_PROBE_CTE} SELECT base, path, CASE path WHEN '/.env' THEN 'exposed--env' ELSE 'exposed--git-HEAD' END AS rule, CASE path WHEN '/.env' THEN 'critical' ELSE 'high' END AS severity FROM probe WHERE status BETWEEN 200 AND 299 AND ((path = '/.env' AND regexp_matches(body, '[A-Z_]+=')) OR (path = '/.git/HEAD' AND regexp_matches(body, 'ref:\\s*refs/')))")
def exposed_paths(spark, sf_dir):
    return response_rules.exposed_findings(spark.sql(_PROBE))


_ROB, _ROB_CTE = values("rob", "site, body", "('a', 'User-agent: GPTBot Disallow: /'), ('b', 'User-agent: * Disallow: /x'), ('c', CAST(NULL AS VARCHAR(9)))")


@query(f"WITH {_ROB_CTE} SELECT site, 'blocks-GPTBot' AS rule FROM rob WHERE regexp_matches(body, '(?i)User-agent:\\s*GPTBot[\\s\\S]*?Disallow:\\s*/\\s*(?:\\n|$)')")
def robots_rules(spark, sf_dir):
    return response_rules.blocked_bots(spark.sql(_ROB))


@query(_rule_rows([("a.io", "weak-spf"), ("a.io", "dmarc-none"), ("a.io", "no-dkim"), ("b.io", "dns-uncheckable"), ("c.io", "no-spf"), ("c.io", "no-dmarc")]).replace("SELECT *", "SELECT col0 AS domain, col1 AS rule"))
def email_auth(spark, sf_dir):
    rows = [("a.io", "txt", True, ["v=spf1 ~all"]), ("a.io", "dmarc", True, ["v=DMARC1; p=none"]), ("a.io", "mx", True, ["mx1"]), ("a.io", "dkim", True, []), ("b.io", "txt", False, []), ("b.io", "dmarc", False, []), ("c.io", "txt", True, ["hello"]), ("c.io", "dmarc", True, [])]
    return response_rules.mail_findings(spark.createDataFrame(rows, "domain string, kind string, ok boolean, answers array<string>"))


_CERT, _CERT_CTE = values("cert", "host, valid_to", "('a', TIMESTAMP '2026-07-10 00:00:00'), ('b', TIMESTAMP '2026-07-30 12:00:00'), ('c', TIMESTAMP '2027-01-01 00:00:00')")


@query(f"WITH {_CERT_CTE}, d AS (SELECT host, CAST(floor(epoch(valid_to - TIMESTAMP '2026-07-19 00:00:00') / 86400.0 + 0.5) AS BIGINT) AS days FROM cert) SELECT host, days, CASE WHEN days < 0 THEN 'cert-expired' ELSE 'cert-expiring' END AS rule FROM d WHERE days < 21")
def cert_expiry(spark, sf_dir):
    return response_rules.certificate_findings(spark.sql(_CERT))


@query("SELECT * FROM (VALUES ('https://a.io/', 'nginx,Vue'), ('http://b.io/', 'Express,Vue'), ('https://c.io/', 'cloudflare,Cloudflare,Vue')) t(url, tech)")
def tech_stack(spark, sf_dir):
    return response_rules.stack(_responses(spark))


_SITES, _SITES_CTE = values("sites", "site, body, sitemap, robots, llms, security_txt", """('a', '<html><script type="application/ld+json"><meta name="viewport" content="x"> gtag(1)', true, false, CAST(NULL AS BOOLEAN), true), ('b', '<meta property="og:title" content="t">', false, true, true, false)""")
_CASES, _CASES_CTE = values(
    "cases", "id, site, rule, severity, verdict, reason, proof, url, reproducible",
    ", ".join(
        f"({i}, '{site}', {row})"
        for i, (site, row) in enumerate(
            (site, row)
            for site in "abc"
            for row in (
                *(f"'{rule}', 'medium', 'confirmed', CAST(NULL AS VARCHAR(9)), 'p', CAST(NULL AS VARCHAR(9)), true" for rule in ("no-security-txt", "no-sitemap", "no-robots", "no-llms-txt", "no-structured-data", "no-jsonld-geo", "missing-viewport", "missing-og", "no-analytics")),
                "'old', 'high', 'rejected', 'x', 'p', NULL, true", "'bare', 'critical', 'confirmed', NULL, NULL, NULL, true", "'bare-low', 'low', 'confirmed', NULL, NULL, NULL, true", "'own', 'low', 'plausible', 'low entropy', 'p', NULL, true",
                "'own-sure', 'low', 'confirmed', 'seen', 'p', NULL, true", "'default', 'low', 'plausible', 'Observe directement.', 'p', NULL, true", "'proved', 'high', 'confirmed', NULL, 'p', 'u', true", "'weak', 'high', 'confirmed', NULL, 'p', 'u', false", "'url-only', 'high', 'confirmed', '', NULL, 'u', true",
            )
        )
    ),
)


@query(
    rf"""WITH {_SITES_CTE}, {_CASES_CTE}, j AS (SELECT c.*, coalesce(s.body, '') AS body, coalesce(s.sitemap, false) AS sitemap, coalesce(s.robots, false) AS robots, coalesce(s.llms, false) AS llms, coalesce(s.security_txt, false) AS sec FROM cases c LEFT JOIN sites s ON s.site = c.site),
    h AS (SELECT *, CASE rule WHEN 'no-security-txt' THEN NOT sec WHEN 'no-sitemap' THEN NOT sitemap WHEN 'no-robots' THEN NOT robots WHEN 'no-llms-txt' THEN NOT llms WHEN 'no-structured-data' THEN NOT contains(body, 'application/ld+json')
      WHEN 'no-jsonld-geo' THEN CASE WHEN NOT contains(body, 'application/ld+json') THEN true END WHEN 'missing-viewport' THEN NOT regexp_matches(body, 'name="viewport"') WHEN 'missing-og' THEN NOT regexp_matches(body, 'og:title')
      WHEN 'no-analytics' THEN CASE WHEN regexp_matches(body, 'gtag\(') THEN false END END AS held FROM j),
    v AS (SELECT id, CASE WHEN verdict = 'rejected' OR held = false THEN 'rejected 0 3' WHEN held THEN 'confirmed 3 0' WHEN proof IS NULL AND url IS NULL AND severity IN ('critical', 'high') THEN 'plausible 1 2' WHEN NOT reproducible THEN 'plausible 2 1'
      WHEN coalesce(reason, '') NOT IN ('', 'Observe directement.') THEN CASE verdict WHEN 'confirmed' THEN 'confirmed 3 0' ELSE verdict || ' 2 1' END WHEN proof IS NOT NULL THEN 'confirmed 3 0' ELSE 'plausible 2 1' END AS x FROM h)
    SELECT id, split_part(x, ' ', 1) AS verdict, CAST(split_part(x, ' ', 2) AS INTEGER) AS votes, CAST(split_part(x, ' ', 3) AS INTEGER) AS refuters FROM v"""
)
def verify_cascade(spark, sf_dir):
    cases = spark.sql(_CASES).withColumn("file", F.lit(None).cast("string")).withColumn("artifact", F.lit(None).cast("string"))
    return findings.verified(cases, spark.sql(_SITES)).select("id", "verdict", "votes", "refuters")


_COL, _COL_CTE = values("col", "fg, bg", "('#000000', '#ffffff'), ('#777777', '#ffffff'), ('#fff', '#fff'), ('#0a0', '#123456')")
_CH = lambda c, i: f"(CASE WHEN length({c}) = 7 THEN CAST(concat('0x', substr({c}, {2 + 2 * i}, 2)) AS INTEGER) ELSE CAST(concat('0x', substr({c}, {2 + i}, 1), substr({c}, {2 + i}, 1)) AS INTEGER) END / 255.0)"
_LUM = lambda c: " + ".join(f"{w} * (CASE WHEN {_CH(c, i)} <= 0.03928 THEN {_CH(c, i)} / 12.92 ELSE pow(({_CH(c, i)} + 0.055) / 1.055, 2.4) END)" for i, w in enumerate((0.2126, 0.7152, 0.0722)))


@query(f"WITH {_COL_CTE}, l AS (SELECT fg, bg, {_LUM('fg')} AS a, {_LUM('bg')} AS b FROM col) SELECT fg, bg, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 3) AS ratio FROM l")
def contrast_ratio(spark, sf_dir):
    lum = lambda c: txt.luminance(*[txt.hex_channel(F.col(c), i) for i in range(3)])
    return spark.sql(_COL).select("fg", "bg", F.round(txt.contrast(lum("fg"), lum("bg")), 3).alias("ratio"))


_STYLED = """<html><head><style>/* x */ @import url(a.css); p.note, #top { color:#777 } @media print { .dim { color: rgba(0,0,0,.4); } }
.big { font-size: 30px; color: #949494 } div.box { background: #333 url(x.png); } div p:hover { color:red }</style></head>
<body><p class="note">Grey words here</p><p class="note">More grey words</p><!-- <p class="note">gone</p> --><p class="dim">Half seen</p>
<h1 class="big">A large heading</h1><div class="box"><p style="color:#555">Dark on dark<br>still dark</p><b>Black inside</b></div>
<p id="top" class="note" style="color:white">Hidden</p><p>Plain text<pre class="note">code</pre></i></body></html>"""
_LINKED = """<body class="page"><link rel="stylesheet" href="/s.css"><link rel="stylesheet" href="https://other.io/t.css"><p>Some linked text</p></body>"""
_PAIRS = "(1, '#999999', '#ffffff', false, 4.5, 1, 'p.dim: Half seen', 'medium'), (1, '#000000', '#333333', false, 4.5, 1, 'b: Black inside', 'high'), (1, '#555555', '#333333', false, 4.5, 1, 'p: Dark on dark still dark', 'high'), (1, '#777777', '#ffffff', false, 4.5, 2, 'p.note: Grey words here', 'medium'), (2, '#808080', '#ffffe0', false, 4.5, 1, 'p: Some linked text', 'medium')"


@query(f"WITH v(page_id, fg, bg, large, least, n, example, severity) AS (VALUES {_PAIRS}), l AS (SELECT *, {_LUM('fg')} AS a, {_LUM('bg')} AS b FROM v), r AS (SELECT *, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 2) AS ratio FROM l) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ratio) AS place, fg, bg, large, ratio, CAST(least AS DOUBLE) AS least, n, example, severity, CASE severity WHEN 'high' THEN 'confirmed' ELSE 'plausible' END AS verdict FROM r")
def low_contrast(spark, sf_dir):
    pages = spark.createDataFrame([(1, "https://a.io/", _STYLED), (2, "https://b.io/x", _LINKED), (3, "https://c.io/", None)], "page_id long, url string, html string")
    sheets = spark.createDataFrame([("https://b.io/s.css", ".page { background-color: #ffffe0; color: gray }"), ("https://other.io/t.css", "p { color: #000 }")], "url string, css string")
    return contrast.weak_pairs(pages, sheets)


_AD = "div.ad { color: #767676; background-color: #eee } li { color: rgb(60%, 60%, 60%) } "


@query(
    rf"""WITH p AS (SELECT page_id, regexp_replace(html, '<!--[\s\S]*?-->|<script[\s\S]*?</script>', '', 'g') AS html FROM pages),
    a AS (SELECT page_id, regexp_extract_all(html, '<div class="ad">([^<]*)<', 1) AS found, '#767676' AS fg, '#eeeeee' AS bg FROM p
      UNION ALL SELECT page_id, regexp_extract_all(html, '<li><a [^>]*>([^<]*)<', 1), '#999999', '#ffffff' FROM p),
    l AS (SELECT *, {_LUM('fg')} AS a, {_LUM('bg')} AS b FROM a),
    n AS (SELECT page_id, fg, bg, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 2) AS ratio, len(list_filter(found, lambda x: length(trim(x)) >= 3 AND regexp_matches(x, '[A-Za-z0-9]'))) AS n FROM l)
    SELECT page_id, fg, bg, ratio, n FROM n WHERE n > 0"""
)
def page_contrast(spark, sf_dir):
    """The pages as a house style would colour them."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit(f"<style>{_AD}</style>"), "html").alias("html"))
    return contrast.weak_pairs(pages).select("page_id", "fg", "bg", "ratio", "n")


_REPO, _REPO_CTE = values("repo", "file, text", """('package.json', '{"dependencies":{"left":"^1.2.3","right":"2.0"},"devDependencies":{"left":"^1.2.3","up":"*"}}'), ('web/package.json', '{"dependencies":{"right":"~3.1.0"}}'), ('web/yarn.lock', ''), ('bad/package.json', 'no json'), ('src/en.json', '{}')""")
_ADV, _ADV_CTE = values("adv", "advisory, name, introduced, fixed, severity", "('A-1', 'left', '1.0.0', '1.2.4', 'high'), ('A-2', 'left', '1.2.4', CAST(NULL AS VARCHAR(9)), 'low'), ('A-3', 'right', CAST(NULL AS VARCHAR(9)), '3.1', 'critical')")


@query("SELECT * FROM (VALUES ('', 'missing-lockfile'), ('/bad', 'missing-lockfile')) t(folder, rule)")
def missing_lockfiles(spark, sf_dir):
    return dependency_rules.unlocked(spark.sql(_REPO))


@query("SELECT * FROM (VALUES ('package.json', 'left', '^1.2.3', 'A-1', 'high', '1.2.4'), ('package.json', 'right', '2.0', 'A-3', 'critical', '3.1')) t(file, name, wanted, advisory, severity, fixed)")
def vulnerable_packages(spark, sf_dir):
    return dependency_rules.vulnerable(dependency_rules.packages(spark.sql(_REPO)), spark.sql(_ADV))


_JSON, _JSON_CTE = values("files", "file, text", """('locales/en.json', '{"a":{"b":"x","c":{"d":[1,2],"e":null}},"f":1}'), ('locales/fr.json', '{"a":{"b":"y"},"f":{}}'), ('locales/de.json', '[broken'), ('data.json', '{"a":1}')""")


@query("SELECT * FROM (VALUES ('locales/en.json', 'a.b'), ('locales/en.json', 'a.c.d'), ('locales/en.json', 'a.c.e'), ('locales/en.json', 'f'), ('locales/fr.json', 'a.b')) t(file, key)")
def locale_keys(spark, sf_dir):
    return readers.locale_keys(spark.sql(_JSON))


_URL, _URL_CTE = values("urls", "url", "('https://x.org/a/b'), ('https://x.org/a/b.git'), ('http://x.org/a'), ('https://x.org/a;rm'), ('git@x.org:a/b'), (CAST(NULL AS VARCHAR(9)))")


@query(rf"WITH {_URL_CTE} SELECT url, CASE WHEN regexp_full_match(url, 'https://[\w.-]+/[\w./-]+') THEN concat(regexp_replace(url, '\.git$', ''), '.git') END AS clone FROM urls")
def clone_urls(spark, sf_dir):
    return spark.sql(_URL).select("url", txt.clone_url(F.col("url")).alias("clone"))


@query("SELECT * FROM (VALUES (1, '9.9.9.9'), (2, '1.1.1.1'), (3, 'unknown'), (4, 'unknown')) t(id, client)")
def clients(spark, sf_dir):
    rows = [(1, {"x-nf-client-connection-ip": "9.9.9.9", "x-forwarded-for": "1.1.1.1"}), (2, {"x-forwarded-for": " 1.1.1.1 , 2.2.2.2"}), (3, {"x-forwarded-for": ""}), (4, {})]
    return spark.createDataFrame(rows, "id int, headers map<string,string>").select("id", txt.client(F.col("headers")).alias("client"))


@query("SELECT event_id, CAST(greatest(1, ceil(((floor((epoch_us(ts) // 1000) / 600000) + 1) * 600000 - (epoch_us(ts) // 1000)) / 1000)) AS BIGINT) AS wait FROM events")
def retry_after(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", quota.retry_after("ts").alias("wait"))


@query(f"WITH f AS ({FINDINGS}) SELECT CASE severity WHEN 'critical' THEN 'P0' WHEN 'high' THEN 'P1' WHEN 'medium' THEN 'P2' ELSE 'P3' END AS tier, count(*) AS n FROM f GROUP BY 1")
def report_tiers(spark, sf_dir):
    return findings.by_tier(order_findings(spark, sf_dir))


_SCO, _SCO_CTE = values("sco", "site, repo, database", "('a', true, true), ('b', true, CAST(NULL AS BOOLEAN)), ('c', false, false)")


@query("SELECT * FROM (VALUES ('a', 15), ('b', 14), ('c', 13)) t(site, agents)")
def active_agents(spark, sf_dir):
    return findings.active_agents(spark.sql(_SCO)).groupBy("site").agg(F.count("*").alias("agents"))


_FIX, _FIX_CTE = values("fixes", "seq, rule, severity, verdict, file, fix", "(1, 'no-robots', 'low', 'confirmed', CAST(NULL AS VARCHAR(9)), 'add it'), (2, 'js-eval', 'high', 'confirmed', 'a.js', 'parse'), (3, 'old', 'high', 'rejected', 'a.js', 'none'), (4, 'weak-hash', 'critical', 'plausible', 'a.js', 'sha256'), (5, 'x', 'info', 'confirmed', 'b.js', 'none')")


@query(
    f"""WITH {_FIX_CTE}, g AS (SELECT coalesce(file, 'general') AS file, seq, severity, fix, CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END AS r FROM fixes WHERE verdict <> 'rejected'),
    p AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY r DESC, seq) AS place FROM g)
    SELECT 'AUDIT.md' AS path, CAST(row_number() OVER (ORDER BY file, place) AS INTEGER) AS line, concat(CASE WHEN place = 1 THEN concat('## ', file, chr(10), chr(10)) ELSE '' END, '- [', severity, '] ', fix) AS content FROM p
    UNION ALL SELECT 'robots.txt', 1, concat('User-agent: *', chr(10), 'Allow: /', chr(10), chr(10), 'Sitemap: https://b.io/sitemap.xml', chr(10)) WHERE EXISTS (SELECT 1 FROM fixes WHERE rule = 'no-robots') AND 'robots.txt' NOT IN ('LICENSE')"""
)
def pull_request_files(spark, sf_dir):
    return writers.added_files(spark.sql(_FIX), spark.sql("SELECT 'LICENSE' AS path"), "https://b.io/")


@query(f"WITH {_FIX_CTE} SELECT count(*) AS n FROM fixes WHERE false")
def files_that_exist_stay(spark, sf_dir):
    return writers.added_files(spark.sql(_FIX), spark.sql("SELECT explode(array('AUDIT.md', 'robots.txt')) AS path"), "https://a.io/").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('scanner:eval-use', 'high', 'a.js', 3, 'CWE-95', 'eval(x)'), ('scanner:odd', 'medium', 'b.py', 1, NULL, 'y')) t(rule, severity, file, line, cwe, match)")
def scanner_report(spark, sf_dir):
    report = """{"results":[{"check_id":"js.eval-use","path":"a.js","start":{"line":3},"extra":{"lines":"eval(x)","severity":"ERROR","metadata":{"cwe":["CWE-95: eval"]}}},{"check_id":"odd","path":"b.py","start":{"line":1},"extra":{"lines":"y","severity":"OTHER","metadata":{"cwe":[]}}}]}"""
    return readers.scanner_findings(spark.sql("SELECT 1").select(F.from_json(F.lit(report), readers.SCANNER).alias("r")).select("r.*"))


@query("SELECT * FROM (VALUES ('axe:image-alt', 'high', 'wcag2a,wcag111', 'img .x'), ('axe:region', 'medium', '', 'div')) t(rule, severity, criterion, targets)")
def axe_report(spark, sf_dir):
    report = """{"violations":[{"id":"image-alt","impact":"critical","tags":["cat.text","wcag2a","wcag111"],"nodes":[{"target":["img"]},{"target":[".x"]}]},{"id":"region","impact":"moderate","tags":[],"nodes":[{"target":["div"]}]}]}"""
    return readers.axe_findings(spark.sql("SELECT 1").select(F.from_json(F.lit(report), readers.AXE).alias("r")).select("r.*"))


_PERF, _PERF_CTE = values("perf", "id, score", "('largest-contentful-paint', 0.3), ('speed-index', 0.8), ('total-blocking-time', 0.95), ('other', 0.1)")


@query("SELECT * FROM (VALUES ('lighthouse:lcp', 'high'), ('lighthouse:speed-index', 'medium')) t(rule, severity)")
def lighthouse_report(spark, sf_dir):
    return readers.lighthouse_findings(spark.sql(_PERF))


# Requests.

_QUOTA = "WITH w AS (SELECT event_id, user_id, ts, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS window_id FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_id ORDER BY ts, event_id) AS r FROM w), p AS (SELECT event_id, row_number() OVER (PARTITION BY window_id ORDER BY ts, event_id) AS g FROM o WHERE r <= 1) SELECT o.event_id, o.window_id, o.r <= 1 AS user_ok, coalesce(g <= 100, false) AS allowed FROM o LEFT JOIN p ON p.event_id = o.event_id"


@query(_QUOTA)
def rate_limit(spark, sf_dir):
    return quota.admitted(table(spark, sf_dir, "events"), seconds=86400, per_user=1, overall=100)


_MSG, _MSG_CTE = values("msg", "id, at, msg", "('x', 1, 'agent:seo started'), ('x', 2, 'agent:seo done (3)'), ('x', 1, 'agent:geo started'), ('y', 4, 'agent:ux done (0)'), ('y', 5, 'hello')")


@query("SELECT * FROM (VALUES ('x', 'seo', 'hit', 3), ('x', 'geo', 'scan', 0), ('y', 'ux', 'clean', 0)) t(id, agent, state, found)")
def progress_state(spark, sf_dir):
    return quota.progress(spark.sql(_MSG))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every page rule in one scan, ranked."""
    return page_findings_ranked(spark, sf_dir)
