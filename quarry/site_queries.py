"""Queries on fixtures in which every rule fires and misses, and on one table of all agents' findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import model, oracles, registry
from quarry.functions import html
from quarry.functions import text as txt
from quarry.operators import audits, canonical, findings, links
from quarry.plans import line_rules, page_rules, response_rules, site_rules
from quarry.queries import _F, _PRIORITY, _RANK, LINKS_SQL, ORACLE, QUERIES, entry, order_findings, query, spread, table, values
from quarry.sinks import writers
from quarry.sources import readers
from quarry.streaming import quota

__all__ = ["ORACLE", "QUERIES", "entry"]

# Pages in which each page rule fires at least once and misses at least once.

_GOOD = (
    '<html lang="en"><head><title>A title</title><meta name="description" content="What it is"><meta name="viewport" content="width=device-width"><meta property="og:title" content="t"><link rel="canonical" href="https://g.io/"><link rel="icon" href="i"><script src="a.js" defer></script>'
    '<script type="application/ld+json">{}</script></head><body><header><a href="/x">One</a></header><h1>A heading of some length</h1><h2>What is it?</h2><p>Our clients trusted it, by the author. Privacy policy, legal notice. Cookie consent. Copyright 2026 matomo</p><img src="i" alt="a" width="1" height="2">'
    '<form><input type="text" id="q"></form><a href="/buy">Buy it</a><button aria-label="x">x</button>'
)
_PAGE_ROWS = [
    (1, "https://g.io/", f"concat('{_GOOD}', repeat(' word', 200))"),
    (2, "https://b.io/", "'<body></body>'"),
    (3, "https://b.io/two", "concat('<html lang=\"fr\"><head><title> </title><meta content=\"x\" name=\"description\"><meta name=\"robots\" content=\"noindex\"><script src=\"a.js\"></script>', repeat('<link rel=\"stylesheet\" href=\"a\">', 5), '</head><h1>One</h1><h1>Two</h1>', repeat('<img src=\"x\">', 6), '<input name=\"q\"><label><input name=\"in\"></label><input type=\"hidden\">')"),
    (4, "https://b.io/3", "concat('<HTML LANG=\"fr-FR\"><h2>Sub</h2><a href=\"/\"> <b></b> </a>', repeat('<button>x</button>', 3), '<meta name=\"viewport\" content=\"user-scalable = no\"><p tabindex=\"3\">', repeat(' the price and your features', 9), ' le prix')"),
    (5, "https://t.io/", "'<script src=\"https://www.googletagmanager.com/gtm.js?id=GTM-AB1\"></script><script>gtag(\"config\", \"G-ABC1234\"); ga(\"create\", \"UA-12345-1\")</script><p>menu.main.title nav.label'"),
    (6, "https://t.io/ua", "'<script src=\"analytics.js\"></script><p style=\"font-size: 11px\">copyright 2019</p><p>one'"),
    (7, "https://t.io/cm", "'<script>gtag(\"consent\", \"default\"); gtag(\"config\", \"G-XYZ9876\")</script><p style=\"font-size: 12px\">© 2026 cookie banner</p>'"),
    (8, "https://f.io/", "concat('<form>', repeat('<input id=\"a\"><select>', 5), '</form><form><textarea></form><header>', repeat('<a href=\"/p\">Contact us</a>', 10), '</header><p>')"),
    (9, "https://f.io/long", "concat('<p>', repeat('lorem ipsum dolor ', 60), '</p>', repeat(' x', 80000))"),
    (10, "https://f.io/qa", "concat('<h3>Ready?</h3><p>', repeat('sit amet elit ', 70), 'auteur avis')"),
    (11, "https://f.io/acc", "'<p>Données personnelles et Mentions légales, Conditions générales; 120 users</p><a href=\"/CGV\">x</a>'"),
    (12, "https://f.io/zoom", "'<meta name=\"viewport\" content=\"maximum-scale=1.0\"><meta name=\"viewport\" content=\"maximum-scale=10\"><a href=\"/privacy\">p</a>'"),
    (13, "https://n.io/", "CAST(NULL AS VARCHAR(9))"),
]
_PAGES, _PAGES_CTE = values("pages", "page_id, url, html", ", ".join(f"({i}, '{u}', {h})" for i, u, h in _PAGE_ROWS))


def _over(sql: str, *ctes: str) -> str:
    """A query over relations that are given, instead of tables of their names."""
    return sql.replace("WITH", f"WITH {', '.join(ctes)},", 1)


@query(_over(oracles.page_findings(), _PAGES_CTE))
def page_rules_fixture(spark, sf_dir):
    return page_rules.findings(spark.sql(_PAGES))


# Lines in which each secret rule fires and misses; the values are put together so that none stands here.
_SECRET_ROWS = ", ".join(
    f"(1, CAST(NULL AS VARCHAR(9)), {i}, {x})"
    for i, x in enumerate(
        (
            "concat('k = sk_live', '_', repeat('a1', 12))", "concat('k = sk_live', '_', repeat('a1', 9))", "concat('rk_live', '_', repeat('Z9', 12))", "concat('xrk_live', '_', repeat('Z9', 12))", "concat('id AKI', 'A', repeat('Q7', 8), ' end')", "concat('id AKI', 'A', repeat('Q7', 9))", "concat('ASI', 'A', repeat('B2', 8))",
            "concat('AIz', 'a', repeat('abcde', 7))", "concat('AIz', 'a', repeat('abcde', 6))", "concat('gh', 'p_', repeat('a1B', 12))", "concat('github', '_pat_', repeat('a_', 11))", "concat('gh', 'x_', repeat('a1B', 12))", "concat('xox', 'b-', repeat('12-ab', 3))", "concat('xox', 'z-', repeat('12-ab', 3))",
            "concat('S', 'G.', repeat('a', 22), '.', repeat('b', 43))", "concat('S', 'G.', repeat('a', 21), '.', repeat('b', 43))", "concat('sk', '-proj-', repeat('aB3', 8))", "concat('task', '-', repeat('aB3', 8))", "concat('-----BEGIN RSA ', 'PRIVATE KEY-----')", "'-----BEGIN PUBLIC KEY-----'", "concat('ey', 'J', repeat('a', 10), '.ey', 'J', repeat('b', 10), '.', repeat('c', 10))",
            "concat('ey', 'J', repeat('a', 10), '.', repeat('b', 10))", "concat('api_key = \"', repeat('q8', 8), '\"')", "concat('API-KEY: \"', repeat('q8', 7), '\"')", "concat('mysecretary = \"', repeat('q8', 8), '\"')", "concat('password = \"', repeat('q8', 8), '\" // audit-ignore')", "concat('password = \"', repeat('q8', 8), '\"')", "concat(repeat(' ', 2001), 'sk_live', '_', repeat('a1', 12))",
        )
    )
)
_SECRETS, _SECRETS_CTE = values("lines", "file, lang, n, line", _SECRET_ROWS)


@query(f"WITH {_SECRETS_CTE}, {oracles.suppressed('lines')} {oracles.line_findings('kept', oracles.SECRET_LINES)}")
def secret_rules_fixture(spark, sf_dir):
    return line_rules.matches(line_rules.unsuppressed(spark.sql(_SECRETS)), line_rules.SECRETS).select("file", "n", "rule", "severity")


_VERD, _VERD_CTE = values("found", "id, line, confidence", "(1, 'a = f(x)', 'high'), (2, 'x.innerHTML = y', 'medium'), (3, 'x.innerHTML = \"y\";', 'medium'), (4, 'z = \"t\"', 'low')")


@query(f"""WITH {_VERD_CTE} SELECT id, CASE WHEN confidence = 'high' OR (confidence = 'medium' AND NOT regexp_matches(line, '=\\s*"[^"]*"\\s*;?\\s*$')) THEN 'confirmed' ELSE 'plausible' END AS verdict FROM found""")
def code_verdicts(spark, sf_dir):
    return line_rules.code_verdicts(spark.sql(_VERD)).select("id", "verdict")


# Sites and repositories.

_SITE, _SITE_CTE = values(
    "sites", "site, sitemap, robots, llms, security_txt, ttfb_ms, http_status, http_location, caa_ok, caa",
    "('https://a.io', true, true, true, true, 800, 301, 'HTTPS://a.io/', true, 1), ('https://b.io', false, NULL, false, NULL, 801, 200, NULL, true, 0), ('https://c.io', true, false, true, true, CAST(NULL AS INT), CAST(NULL AS INT), NULL, false, 0), ('https://d.io', true, true, true, true, 10, 302, 'http://d.io/', NULL, 0)",
)


@query(
    f"""WITH {_SITE_CTE} SELECT site, 'seo' AS agent, 'no-sitemap' AS rule, 'medium' AS severity, 0.3::DOUBLE AS effort, 0 AS gain_eur FROM sites WHERE sitemap IS NOT true UNION ALL SELECT site, 'seo', 'no-robots', 'low', 0.1, 0 FROM sites WHERE robots IS NOT true
    UNION ALL SELECT site, 'geo', 'no-llms-txt', 'medium', 0.3, 0 FROM sites WHERE llms IS NOT true UNION ALL SELECT site, 'infra', 'no-security-txt', 'info', 0.1, 0 FROM sites WHERE security_txt IS NOT true UNION ALL SELECT site, 'perf', 'high-ttfb', 'medium', 0.5, 1500 FROM sites WHERE ttfb_ms > 800
    UNION ALL SELECT site, 'infra', 'no-https-redirect', 'high', 0.2, 0 FROM sites WHERE http_status IS NOT NULL AND NOT (http_status BETWEEN 300 AND 399 AND lower(coalesce(http_location, '')) LIKE 'https:%') UNION ALL SELECT site, 'infra', 'no-caa', 'low', 0.2, 0 FROM sites WHERE caa_ok AND caa = 0"""
)
def site_rules_fixture(spark, sf_dir):
    sites = spark.sql(_SITE).withColumn("caa", F.when(F.col("caa") > 0, F.array(F.lit("0 issue"))).otherwise(F.array().cast("array<string>")))
    return site_rules.site_findings(sites)


_MIX, _MIX_CTE = values("mix", "page_id, url, html", """(1, 'https://a.io/', '<script src="http://x.io/a.js"></script><IMG alt="" SRC="http://y.io/i">'), (2, 'http://a.io/', '<img src="http://x.io/a">'), (3, 'https://a.io/3', '<img src="https://x.io/a"><a href="http://x.io/">x</a>'), (4, 'https://a.io/4', CAST(NULL AS VARCHAR(9)))""")
_MIXED = "'(?i)<(script|img|iframe|link|source|video|audio)\\b[^>]*\\b(src|href)=[\"'']http://[^\"'']+'"


@query(f"WITH {_MIX_CTE}, f AS (SELECT page_id, url, regexp_extract_all(html, {_MIXED}) AS found FROM mix WHERE url LIKE 'https://%') SELECT page_id, url, len(found) AS n, left(found[1], 120) AS proof FROM f WHERE len(found) > 0")
def mixed_content(spark, sf_dir):
    return site_rules.mixed_content(spark.sql(_MIX))


_CORS, _CORS_CTE = values("cors", "url, probe_origin, allow_origin, allow_credentials", "('a', 'https://p', 'https://p', 'TRUE'), ('b', 'https://p', 'https://p', NULL), ('c', 'https://p', '*', 'true'), ('d', 'https://p', '*', 'false'), ('e', 'https://p', NULL, 'true'), ('f', 'https://p', 'https://q', 'true')")


@query(f"WITH {_CORS_CTE} SELECT url, 'cors-reflected-origin' AS rule, CASE WHEN lower(allow_credentials) = 'true' THEN 'high' ELSE 'medium' END AS severity FROM cors WHERE allow_origin = probe_origin OR (allow_origin = '*' AND lower(allow_credentials) = 'true')")
def cors_severity(spark, sf_dir):
    return site_rules.cors_findings(spark.sql(_CORS))


_LF = "chr(10)"
_FILE_ROWS = ", ".join(
    [f"('a', 'src/big{i}.js', repeat(concat('x', chr(10)), 600))" for i in range(7)]
    + ["('a', 'src/m.js', concat('ok', chr(10), ' // TODO later', chr(10), 'console.log(1)', chr(10), 'FIXME'))", "('a', 'src/z.py', 'print(x) # HACK')", "('a', 'node_modules/q.js', 'TODO')", "('a', 'a.md', 'TODO')", "('a', '.env', 'A=1')", "('a', 'x/.env.local', 'A=1')", "('a', '.env.example', 'A=1')", "('a', 'db/schema.sql', 'x')"]
    + [f"('b', 'f{i}.js', 'x')" for i in range(9)]
    + ["('b', 'tests/t.js', 'y')", "('b', 'huge.js', repeat('TODO ', 160001))", "('b', 'db/Migrations_v1/1.sql', 'z')", "('c', 'm.js', repeat(concat('x', chr(10)), 599))", "('c', 'x/y/z/w/.env', 'A=1')"]
)
_FILES, _FILES_CTE = values("files", "repo, file, text", _FILE_ROWS)
_COUNTS = f"""WITH {_FILES_CTE}, k AS (SELECT repo, file, regexp_matches(file, '\\.(test|spec)\\.|__tests__|(^|/)tests?/') AS test, strlen(text) <= 800000 AS read, string_split_regex(text, '\\r?\\n') AS rows FROM files
      WHERE regexp_matches(file, '\\.(js|ts|jsx|tsx|mjs|cjs|py|go|rb|php|java)$') AND NOT regexp_matches(file, '(^|/)(node_modules|\\.git|dist|build|\\.next|out|coverage|vendor)/')),
    l AS (SELECT repo, file, read, unnest(rows) AS line, generate_subscripts(rows, 1) AS n FROM k WHERE read),
    m AS (SELECT *, regexp_matches(line, '\\b(TODO|FIXME|HACK|XXX)\\b') AS todo, regexp_matches(line, 'console\\.(log|debug)\\(|debugger;|print\\(|var_dump\\(') AS debug FROM l),
    c AS (SELECT repo, file, count(*) AS lines, count(*) FILTER (todo) AS todos, count(*) FILTER (debug) AS debugs, min(n) FILTER (todo) AS t1, min(n) FILTER (debug) AS d1 FROM m GROUP BY ALL),
    r AS (SELECT k.repo, count(*) FILTER (read) AS files, coalesce(sum(lines), 0) AS total_lines, count(*) FILTER (test) AS test_files, coalesce(sum(todos), 0) AS todos, coalesce(sum(debugs), 0) AS debugs, count(*) FILTER (lines > 600) AS big_files FROM k LEFT JOIN c ON c.repo = k.repo AND c.file = k.file GROUP BY k.repo)"""


@query(
    f"""{_COUNTS} SELECT repo, 'large-file' AS rule, 'low' AS severity, 0.5::DOUBLE AS effort, file, 1 AS line, lines AS n FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file) AS place FROM c WHERE lines > 600) WHERE place <= 5
    UNION ALL SELECT r.repo, 'todo-debt', 'info', least(2, round(r.todos * 0.1, 10)), x.file, x.t1, r.todos FROM r JOIN (SELECT repo, min(file) AS file, arg_min(t1, file) AS t1 FROM c WHERE todos > 0 GROUP BY repo) x ON x.repo = r.repo
    UNION ALL SELECT r.repo, 'debug-left', 'low', 0.2, x.file, x.d1, r.debugs FROM r JOIN (SELECT repo, min(file) AS file, arg_min(d1, file) AS d1 FROM c WHERE debugs > 0 GROUP BY repo) x ON x.repo = r.repo
    UNION ALL SELECT repo, 'no-tests', 'medium', 1.5, 'package.json', 1, files FROM r WHERE files > 8 AND test_files = 0"""
)
def code_findings(spark, sf_dir):
    return site_rules.code_findings(spark.sql(_FILES))


@query(f"{_COUNTS} SELECT repo, files, CAST(total_lines AS BIGINT) AS total_lines, test_files, CAST(todos AS BIGINT) AS todos, CAST(debugs AS BIGINT) AS debugs, big_files FROM r")
def code_totals(spark, sf_dir):
    return site_rules.code_totals(site_rules.code_counts(spark.sql(_FILES))).select("repo", "files", "total_lines", "test_files", "todos", "debugs", "big_files")


@query(f"WITH {_FILES_CTE} SELECT repo, 'no-migrations' AS rule, 'low' AS severity, 0.5::DOUBLE AS effort, '.' AS file, 1 AS line, CASE repo WHEN 'c' THEN 2 ELSE 0 END AS n FROM files GROUP BY repo HAVING (bool_or(regexp_matches(file, '(?i)\\.sql$')) OR repo = 'c') AND NOT bool_or(regexp_matches(file, '(?i)migration[^/]*/'))")
def missing_migrations(spark, sf_dir):
    return site_rules.migration_findings(spark.sql(_FILES), spark.sql("SELECT explode(array('c', 'c', 'b')) AS repo"))


@query(f"WITH {_FILES_CTE} SELECT repo, 'env-committed' AS rule, 'high' AS severity, 0.3::DOUBLE AS effort, file, 1 AS line, 1 AS n FROM files WHERE regexp_matches(file, '(^|/)\\.env(\\.[^/]*)?$') AND NOT regexp_matches(file, '\\.(example|sample)$') AND len(string_split(file, '/')) <= 4")
def committed_env(spark, sf_dir):
    return site_rules.env_findings(spark.sql(_FILES))


# One table of findings.

_GAIN = "CASE rule WHEN 'heavy-html' THEN 2000 WHEN 'render-blocking-js' THEN 1800 WHEN 'many-css' THEN 600 WHEN 'img-no-dims' THEN 700 WHEN 'no-lazy' THEN 500 WHEN 'no-cta' THEN 4000 WHEN 'weak-value-prop' THEN 2500 WHEN 'no-social-proof' THEN 1500 WHEN 'cta-overload' THEN 800 ELSE 0 END"
_RISK = "CASE rule WHEN 'tracker-no-cmp' THEN 12000 WHEN 'no-privacy-link' THEN 4000 WHEN 'no-legal-notice' THEN 3000 ELSE CASE severity " + " ".join(f"WHEN '{k}' THEN {v[5]}" for k, v in model.SEVERITY.items()) + " END END"
_ID = "concat(upper(left(agent, 3)), '-', ltrim(array_to_string(list_transform([6, 5, 4, 3, 2, 1, 0], lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((h // CAST(pow(36, i) AS BIGINT)) % 36 AS INTEGER) + 1, 1)), ''), '0'))"
_HASHED = "list_reduce(list_concat([CAST(5381 AS BIGINT)], list_transform(string_split(concat(rule, ':', url, ':0'), ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: (h * 33 + c) & 4294967295)"
_AGENT_N = "CASE agent " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in model.AGENTS.items()) + " END"
_FAMILY = "CASE agent " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in model.AGENTS.items()) + " END"
_ORIGIN = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_TABLE = f"""WITH f AS ({oracles.page_findings()}), w AS (SELECT *, {_ORIGIN} AS site, {_GAIN} AS gain, {_HASHED} AS h FROM f),
    t AS (SELECT site, {_ID} AS id, agent, {_AGENT_N} AS agent_n, {_FAMILY} AS family, rule, severity, url, CASE WHEN gain > 0 THEN 'gain' ELSE 'risk' END AS kind, CAST(CASE WHEN gain > 0 THEN 0 ELSE {_RISK} END AS DOUBLE) AS risk_eur, CAST(gain AS DOUBLE) AS gain_eur, effort, verdict,
      CASE verdict WHEN 'plausible' THEN 2 ELSE 3 END AS votes, CASE verdict WHEN 'plausible' THEN 1 ELSE 0 END AS refuters, concat(url, '::', rule) AS loc_key, page_id * 1000 + emit_seq AS seq FROM w)"""


def _frames(spark, sf_dir):
    return {"pages": spread(table(spark, sf_dir, "pages"))}


@query(f"{_TABLE} SELECT site, id, agent, agent_n, family, rule, severity, url, kind, risk_eur, gain_eur, effort, verdict, votes, refuters, loc_key FROM t")
def findings_table(spark, sf_dir):
    found = canonical.canonical(registry.run(spark, _frames(spark, sf_dir)))
    return found.select("site", "id", "agent", "agent_n", "family", "rule", "severity", "location.url", "business.kind", "business.risk_eur", "business.gain_eur", "effort", "check.verdict", "check.votes", "check.refuters", "loc_key")


_LOWS = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in model.SEVERITY.items()) + " END"
_HIGHS = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v[2]}" for k, v in model.SEVERITY.items()) + " END"
_WEIGHTS = "CASE agent " + " ".join(f"WHEN '{k}' THEN {v[2]}::DOUBLE" for k, v in model.AGENTS.items()) + " ELSE 0.5 END"
# Pages of one address are one place: the first agent's first finding stands for its rule there.
_MERGED = f"""{_TABLE}, m AS (SELECT site, loc_key, arg_min(agent, (agent_n, seq)) AS agent, min(agent_n) AS agent_n, any_value(rule) AS rule, any_value(severity) AS severity, any_value(kind) AS kind, any_value(effort) AS effort, any_value(verdict) AS verdict, count(*) AS merged FROM t GROUP BY site, loc_key)"""


@query(f"{_MERGED} SELECT site, loc_key, agent, rule, severity, merged, {_PRIORITY} AS priority, CAST({_LOWS} AS BIGINT) AS low, CAST({_HIGHS} AS BIGINT) AS high FROM m")
def audit_findings(spark, sf_dir):
    return registry.audit(spark, _frames(spark, sf_dir)).select("site", "loc_key", "agent", "rule", "severity", "merged", "priority", "low", "high")


_DIM = "d(agent, agent_n, weight) AS (VALUES " + ", ".join(f"('{a}', {v[0]}, {v[2]}::DOUBLE)" for a, v in model.AGENTS.items()) + ")"
_DOMAIN = f"""{_MERGED}, {_DIM}, s AS (SELECT site, agent, count(*) AS n, sum({_RANK} * {_RANK}) AS p, max({_RANK}) AS worst FROM m GROUP BY ALL),
    g AS (SELECT x.site, d.agent, d.agent_n, d.weight, coalesce(n, 0) AS n, coalesce(p, 0) AS p, coalesce(worst, 0) AS worst, d.agent NOT IN ('deps', 'code-arch', 'data') AS evaluated, d.agent = 'security' AS partial FROM (SELECT DISTINCT site FROM m) x CROSS JOIN d LEFT JOIN s ON s.site = x.site AND s.agent = d.agent),
    o AS (SELECT *, CASE WHEN evaluated THEN CAST(greatest(0, floor(100 - 100.0::DOUBLE * p / (p + 40) + 0.5)) AS BIGINT) END AS score, CASE worst WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' WHEN 1 THEN 'info' ELSE '' END AS word FROM g)"""


@query(
    f"""{_DOMAIN} SELECT site, agent, n, word AS worst, evaluated, partial, score, CASE WHEN NOT evaluated THEN 'not evaluated without code' WHEN partial AND n > 0 THEN concat(n, ' on the outer surface; code not evaluated') WHEN partial THEN 'clean outer surface; code not evaluated' WHEN n = 0 THEN 'no problem found' ELSE concat(n, ' found, worst: ', word) END AS note,
    CAST(row_number() OVER (PARTITION BY site ORDER BY evaluated DESC, coalesce(score, -1) DESC, agent_n) AS INTEGER) AS place FROM o"""
)
def audit_domains(spark, sf_dir):
    told = canonical.domains(registry.audit(spark, _frames(spark, sf_dir)))
    return canonical.ordered_domains(told).select("site", "agent", "n", "worst", "evaluated", "partial", "score", "note", "place")


@query(
    f"""{_DOMAIN}, b AS (SELECT site, count(*) AS total_findings, {', '.join(f"count(*) FILTER (severity = '{k}') AS {k}" for k in model.SEVERITY)}, round(sum(effort), 1) AS effort_days, CAST(greatest(0, floor(100 - 100 * sum({_WEIGHTS} * {_RANK} * {_RANK}) / (sum({_WEIGHTS} * {_RANK} * {_RANK}) + 120) + 0.5)) AS BIGINT) AS score,
      {', '.join(f"CAST(coalesce(sum(CASE WHEN kind = '{kind}' THEN {sql} END), 0) AS BIGINT) AS {kind}_{end}" for kind in ('risk', 'gain') for end, sql in (('low', _LOWS), ('high', _HIGHS)))} FROM m GROUP BY site),
    z AS (SELECT site, CAST(floor(sum(score * weight) FILTER (evaluated) / sum(weight) FILTER (evaluated) + 0.5) AS BIGINT) AS weighted_score, count(*) FILTER (evaluated) AS evaluated_count, count(*) FILTER (NOT evaluated) AS not_evaluated_count, arg_max(agent, score * 100 - agent_n) FILTER (evaluated) AS strongest, arg_min(agent, score * 100 + agent_n) FILTER (evaluated) AS weakest FROM o GROUP BY site)
    SELECT b.*, CAST(floor((risk_low + risk_high) / 2 + 0.5) AS BIGINT) AS risk_eur, CAST(floor((gain_low + gain_high) / 2 + 0.5) AS BIGINT) AS gain_eur, weighted_score, evaluated_count, not_evaluated_count, strongest, weakest FROM b JOIN z ON z.site = b.site"""
)
def audit_summary(spark, sf_dir):
    return canonical.synthesis(registry.audit(spark, _frames(spark, sf_dir)))


_BY_RULE = (
    f"""WITH f AS ({oracles.page_findings()}), p AS (SELECT {_ORIGIN} AS site, agent, rule, severity, page_id, url, coalesce(nullif(substr(url, length({_ORIGIN}) + 1), ''), '/') AS path FROM f WHERE agent IN ('seo', 'legal')),
    u AS (SELECT site, agent, rule, severity, path, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM p GROUP BY site, agent, rule, severity, path),
    r AS (SELECT *, row_number() OVER (PARTITION BY site, agent, rule, severity ORDER BY page_id, url) AS place FROM u)
    SELECT site, agent, rule, severity, count(*) AS pages, min(page_id) AS first_page, arg_min(url, place) AS url, concat(rule, CASE WHEN count(*) > 1 THEN concat(' (on ', count(*), ' pages)') ELSE '' END) AS title, string_agg(path, ', ' ORDER BY place) FILTER (place <= 6) AS paths FROM r GROUP BY site, agent, rule, severity"""
)

@query(_BY_RULE)
def rules_by_page(spark, sf_dir):
    return _by_rule(spread(table(spark, sf_dir, "pages")), ("seo", "legal"))


@query(_over(_BY_RULE.replace("'seo', 'legal'", "'a11y', 'content'"), _PAGES_CTE))
def rules_by_page_fixture(spark, sf_dir):
    return _by_rule(spark.sql(_PAGES), ("a11y", "content"))


def _by_rule(pages, agents):
    found = page_rules.findings(pages, agents)
    return canonical.by_rule(found.withColumn("site", links.origin(F.col("url"))))


_RAW, _RAW_CTE = values("raws", "site, agent, rule, severity, url, file, line, selector, effort, verdict, emit_seq", """('s', 'security', 'Weak  Hash!', 'low', CAST(NULL AS VARCHAR(9)), 'a.js', 3, CAST(NULL AS VARCHAR(9)), CAST(NULL AS DOUBLE), 'confirmed', 1), ('s', 'security', 'weak-hash', 'critical', NULL, 'a.js', 3, NULL, 0.4, 'confirmed', 2), ('s', 'security', 'js-eval', 'high', NULL, 'b.js', NULL, NULL, 0.1, 'rejected', 3),
 ('s', 'security', 'no-tls', 'high', 'http://s/', '', NULL, NULL, 0.3, NULL, 4), ('s', 'seo', 'No TLS', 'critical', 'http://s/', NULL, NULL, NULL, 0.2, 'plausible', 1), ('s', 'ux', 'far', 'info', NULL, NULL, NULL, 'p.x', 0.0, 'confirmed', 1), ('s', 'ux', 'far', 'low', NULL, NULL, NULL, NULL, 0.5, 'confirmed', 2), ('t', 'seo', 'no-tls', 'low', 'http://s/', NULL, NULL, NULL, 0.5, 'confirmed', 9)""")
_KEYED = f"""WITH {_RAW_CTE}, k AS (SELECT *, concat(CASE WHEN url IS NULL AND coalesce(file, '') <> '' THEN concat(file, ':', coalesce(line, 0)) ELSE coalesce(nullif(url, ''), nullif(selector, ''), 'global') END, '::', regexp_replace(regexp_replace(lower(rule), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS loc_key, {_AGENT_N} AS agent_n, {_RANK} AS r FROM raws WHERE coalesce(verdict, '') <> 'rejected')"""


@query(f"{_KEYED}, x AS (SELECT site, loc_key, agent, min((agent_n, emit_seq)) AS at FROM k GROUP BY ALL) SELECT k.site, k.loc_key, arg_min(k.agent, (agent_n, emit_seq)) AS agent, arg_max(severity, r) AS severity, arg_min(coalesce(effort, 0.3), (agent_n, emit_seq)) AS effort, count(*) AS merged, (SELECT string_agg(x.agent, ',' ORDER BY x.at) FROM x WHERE x.site = k.site AND x.loc_key = k.loc_key) AS raised_by FROM k GROUP BY k.site, k.loc_key")
def merged_findings(spark, sf_dir):
    return canonical.merge(canonical.canonical(spark.sql(_RAW))).select("site", "loc_key", "agent", "severity", "effort", "merged", F.array_join("raised_by", ",").alias("raised_by"))


@query(f"{_KEYED}, o AS (SELECT *, row_number() OVER (PARTITION BY site, loc_key ORDER BY emit_seq) AS place FROM k WHERE agent = 'security') SELECT loc_key, severity, CAST({_RISK} AS DOUBLE) AS risk_eur FROM o WHERE place = 1")
def security_report(spark, sf_dir):
    return canonical.security_report(canonical.canonical(spark.sql(_RAW))).select("loc_key", "severity", F.col("business.risk_eur").alias("risk_eur"))


@query(f"{_KEYED} SELECT (SELECT count(*) FROM raws WHERE agent = 'security') AS raw_matches, (SELECT count(*) FROM raws WHERE agent = 'security' AND verdict = 'rejected') AS rejected, count(DISTINCT loc_key) AS reported, CAST(sum({_RISK}) FILTER (emit_seq IN (1, 4)) AS DOUBLE) AS risk_eur FROM k WHERE agent = 'security'")
def security_totals(spark, sf_dir):
    every = canonical.canonical(spark.sql(_RAW))
    told = canonical.security_report(every).agg(F.count("*").alias("reported"), F.sum("business.risk_eur").alias("risk_eur"))
    raw = every.where("agent = 'security'").agg(F.count("*").alias("raw_matches"), F.count_if(F.col("check.verdict") == "rejected").alias("rejected"))
    return raw.join(told)


@query(_F + f"SELECT {', '.join(f'count(*) FILTER (severity = {chr(39)}{k}{chr(39)}) AS {k}' for k in model.SEVERITY)}, round(sum(effort), 1) AS effort_days FROM f WHERE severity IN ('critical', 'high')")
def severity_filter(spark, sf_dir):
    f = order_findings(spark, sf_dir).where(F.col("severity").isin("critical", "high"))
    return f.agg(*[F.count_if(F.col("severity") == k).alias(k) for k in model.SEVERITY], F.round(F.sum("effort"), 1).alias("effort_days"))


@query(_F + f"SELECT seq, severity FROM f ORDER BY {_RANK} DESC, {_PRIORITY} DESC, seq LIMIT 5")
def message_findings(spark, sf_dir):
    return findings.top(order_findings(spark, sf_dir), 5).select("seq", "severity")


@query(_F + f"SELECT seq, severity FROM f ORDER BY {_RANK} DESC, {_PRIORITY} DESC, seq LIMIT 12")
def printed_findings(spark, sf_dir):
    return findings.top(order_findings(spark, sf_dir), 12).select("seq", "severity")


_ELI, _ELI_CTE = values("eli", "page_id, status, error", "(1, 200, CAST(NULL AS VARCHAR(9))), (2, 404, NULL), (3, 200, 'timeout'), (4, CAST(NULL AS INT), NULL)")


@query(f"WITH {_ELI_CTE} SELECT page_id FROM eli WHERE status = 200 AND error IS NULL")
def eligible_pages(spark, sf_dir):
    return registry.eligible(spark.sql(_ELI)).select("page_id")


# Values.

_TXT, _TXT_CTE = values("txt", "id, a", "(1, '  My Site: 2026!! A very long name indeed  '), (2, 'https://a.io/'), (3, 'http://b.io/x/'), (4, ''), (5, CAST(NULL AS VARCHAR(9))), (6, 'See [the docs](https://x.io/a)   now'), (7, 'Été à Noël, ÇA VA'), (8, '---')")


@query(
    rf"""WITH {_TXT_CTE} SELECT id, concat('audit/', left(regexp_replace(regexp_replace(lower(a), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 24)) AS branch, regexp_replace(regexp_replace(coalesce(a, ''), '^https?://', ''), '/$', '') AS host,
    left(trim(regexp_replace(regexp_replace(coalesce(a, ''), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\s+', ' ', 'g')), 200) AS words, regexp_replace(regexp_replace(lower(coalesce(a, '')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, CASE WHEN a IS NOT NULL THEN strip_accents(lower(a)) END AS folded, coalesce(nullif(replace(a, 'https://a.io', ''), ''), '/') AS path FROM txt"""
)
def names_and_words(spark, sf_dir):
    a = F.col("a")
    return spark.sql(_TXT).select(
        "id", F.concat(F.lit("audit/"), F.substr(F.coalesce(writers.branch(a), F.lit("audit/")), F.lit(7))).alias("branch"), writers.clean_host(a).alias("host"), writers.without_markdown(a).alias("words"), txt.slug(a).alias("slug"), F.translate(F.lower(a), *page_rules.FOLDED).alias("folded"), canonical.short_path(a, F.lit("https://a.io")).alias("path")
    )


_HOST, _HOST_CTE = values("hosts", "raw, own, host", "('a.io', 'https://a.io', 'a.io'), ('HTTP', 'https://http', 'http'), ('http://B.io:80/x?y', 'http://b.io:80', 'b.io:80'), ('https://u:p@c.io/', 'https://c.io', 'c.io'), ('', '', ''), (CAST(NULL AS VARCHAR(9)), CAST(NULL AS VARCHAR(9)), CAST(NULL AS VARCHAR(9))), ('https://', 'https://', '')")


@query(f"WITH {_HOST_CTE} SELECT raw, own, host FROM hosts")
def hosts(spark, sf_dir):
    return spark.sql(_HOST).select("raw", txt.origin_of(F.col("raw")).alias("own"), txt.host_of(F.col("raw")).alias("host"))


@query(
    f"""WITH {_PAGES_CTE} SELECT page_id, nullif(trim(regexp_extract(html, '(?i)<title\\b[^>]*>([\\s\\S]*?)</title>', 1)), '') AS title, array_to_string(regexp_extract_all(html, '(?i)<h1\\b[^>]*>([\\s\\S]*?)</h1>', 1), '|') AS headings,
    CASE WHEN regexp_matches(html, '(?i)<meta\\b[^>]*name="viewport"') THEN regexp_extract(regexp_extract(html, '(?i)<meta\\b[^>]*name="viewport"[^>]*>'), '(?i)\\bcontent\\s*=\\s*"([^"]*)"', 1) END AS viewport FROM pages"""
)
def html_parts(spark, sf_dir):
    return spark.sql(_PAGES).select("page_id", html.tag(F.col("html"), "title").alias("title"), F.array_join(html.tags(F.col("html"), "h1"), "|").alias("headings"), html.meta(F.col("html"), "name=[\"']viewport").alias("viewport"))


_MIXES, _MIXES_CTE = values("mixes", "front, back, alpha", "(0, 255, 0.5), (255, 255, 0.3), (10, 200, 1.0), (10, 200, 0.0), (3, 4, 0.5)")


@query(f"WITH {_MIXES_CTE} SELECT front, back, CAST(alpha AS DOUBLE) AS alpha, CAST(floor(front * CAST(alpha AS DOUBLE) + back * (1 - CAST(alpha AS DOUBLE)) + 0.5) AS BIGINT) AS mixed FROM mixes")
def blended_colours(spark, sf_dir):
    alpha = F.col("alpha").cast("double")
    return spark.sql(_MIXES).select("front", "back", alpha.alias("alpha"), txt.flatten(F.col("front"), F.col("back"), alpha).alias("mixed"))


@query("SELECT c_mktsegment AS tenant, c_name AS email, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey, c_name) AS INTEGER) AS place FROM customer")
def member_list(spark, sf_dir):
    return audits.members(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("tenant"), F.col("c_name").alias("email"), F.col("c_custkey").alias("at"))).select("tenant", "email", "place")


_SCORE, _SCORE_CTE = values("scores", "score", "(100), (85), (84), (80), (79), (70), (69), (50), (49), (0)")


@query(f"WITH {_SCORE_CTE} SELECT score, CASE WHEN score >= 85 THEN 'solid' WHEN score >= 70 THEN 'good base' WHEN score >= 50 THEN 'to consolidate' ELSE 'priority work' END AS band, CASE WHEN score >= 80 THEN 'ok' WHEN score >= 50 THEN 'warn' ELSE 'bad' END AS sign, least(30, greatest(1, score)) AS pages, regexp_replace(format('{{:,}}', score * 12345), ',', ' ', 'g') AS euros FROM scores")
def score_bands(spark, sf_dir):
    score = F.col("score")
    return spark.sql(_SCORE).select("score", writers.band(score).alias("band"), writers.sign(score).alias("sign"), model.pages_allowed(score).alias("pages"), writers.euros(score * 12345).alias("euros"))


_BRO, _BRO_CTE = values("bro", "site, browser_scan, repo", "('a', true, false), ('b', false, true), ('c', CAST(NULL AS BOOLEAN), true), ('d', NULL, false), ('e', NULL, NULL)")


@query(f"WITH {_BRO_CTE} SELECT site, coalesce(browser_scan, repo, false) AS allowed FROM bro")
def browser_allowed(spark, sf_dir):
    return readers.browser_allowed(spark.sql(_BRO))


@query(f"WITH {_BRO_CTE} SELECT site, false AS allowed FROM bro")
def browser_switched_off(spark, sf_dir):
    return readers.browser_allowed(spark.sql(_BRO), enabled=False)


_REL, _REL_CTE = values(
    "rel", "href, want",
    "('x', 'https://a.io/p/q/x'), ('./x', 'https://a.io/p/q/x'), ('../x', 'https://a.io/p/x'), ('../../x', 'https://a.io/x'), ('../../../x', 'https://a.io/x'), ('/a/./b/../c', 'https://a.io/a/c'), ('..', 'https://a.io/p/'), ('.', 'https://a.io/p/q/'), ('/a/..', 'https://a.io/'), ('?k=..', 'https://a.io/p/q/r?k=..'), ('//b.io/../y?z#f', 'https://b.io/y?z#f'), ('a..b/c', 'https://a.io/p/q/a..b/c'), ('#f', 'https://a.io/p/q/r')",
)


@query(f"WITH {_REL_CTE} SELECT href, want AS url FROM rel")
def relative_addresses(spark, sf_dir):
    return spark.sql(_REL).select("href", links.resolve(F.col("href"), F.lit("https://a.io/p/q/r")).alias("url"))


@query(
    f"""WITH {LINKS_SQL.replace("raw AS (SELECT url,", "raw AS (SELECT page_id, url, generate_subscripts(regexp_extract_all(coalesce(html, ''), '(?i)<a\\b[^>]*\\bhref\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1), 1) AS pos,").replace("own AS (SELECT url,", "own AS (SELECT page_id, pos, url,").replace("abs AS (SELECT url,", "abs AS (SELECT page_id, pos, url,")},
    p AS (SELECT page_id, pos, regexp_replace(full_url, '[?#].*$', '') AS u, origin FROM abs), q AS (SELECT page_id, coalesce(nullif(substr(u, length(origin) + 1), ''), '/') AS path, min(pos) AS pos FROM p WHERE regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) = origin GROUP BY ALL)
    SELECT page_id, CAST(place AS INTEGER) AS place, path FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS place FROM q) WHERE place <= 100"""
)
def page_paths(spark, sf_dir):
    return links.paths(table(spark, sf_dir, "pages"))


# Audits and their events.

_TENANTS = "a AS (SELECT o_custkey % 7 AS tenant, o_custkey % 50 AS target, o_orderkey AS id, o_orderdate AS made, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'running' END AS status FROM orders)"


def _tenant_audits(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("tenant"), (F.col("o_custkey") % 50).alias("target"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("running").alias("status"))


@query(f"WITH {_TENANTS} SELECT tenant, id, CAST(row_number() OVER (PARTITION BY tenant ORDER BY made DESC, id DESC) AS INTEGER) AS place FROM a QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY made DESC, id DESC) <= 30")
def audit_list(spark, sf_dir):
    return audits.listed(_tenant_audits(spark, sf_dir)).select("tenant", "id", "place")


@query(f"WITH {_TENANTS} SELECT tenant, target, id, CAST(row_number() OVER (PARTITION BY tenant, target ORDER BY made DESC, id DESC) AS INTEGER) AS place FROM a WHERE status = 'done' QUALIFY row_number() OVER (PARTITION BY tenant, target ORDER BY made DESC, id DESC) <= 20")
def audits_done(spark, sf_dir):
    return audits.completed(_tenant_audits(spark, sf_dir)).select("tenant", "target", "id", "place")


@query("SELECT c_custkey AS audit_id, o_orderkey AS finding_id, CAST(CASE WHEN o_orderkey IS NOT NULL THEN row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) END AS INTEGER) AS place FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def audit_with_findings(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("audit_id"))
    f = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("audit_id"), F.col("o_orderkey").alias("finding_id"), F.col("o_totalprice").alias("priority"))
    return audits.with_findings(a, f).select("audit_id", "finding_id", "place")


_EVT, _EVT_CTE = values("evt", "id, seq, type, data", "('x', 1, 'status', 'running'), ('x', 2, 'log', 'a \"b\"'), ('x', 3, 'done', '42'), ('x', 4, 'log', 'late'), ('y', 1, 'log', CAST(NULL AS VARCHAR(9))), ('y', 2, 'error', 'boom'), ('y', 3, 'done', '1'), ('z', 5, 'log', 'on')")


@query(
    f"""WITH {_EVT_CTE}, e AS (SELECT *, (SELECT min(seq) FROM evt o WHERE o.id = evt.id AND o.type IN ('done', 'error')) AS stop FROM evt)
    SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY seq) AS INTEGER) AS place, type IN ('done', 'error') AS last, CASE WHEN data IS NULL THEN concat('{{"type":"', type, '"}}') ELSE concat('{{"type":"', type, '","data":', to_json(data), '}}') END AS value FROM e WHERE stop IS NULL OR seq <= stop"""
)
def event_lines(spark, sf_dir):
    return quota.until_end(spark.sql(_EVT))


_MSGS, _MSGS_CTE = values("msg", "id, made, msg", "('x', 1, 'agent:seo started'), ('x', 2, 'agent:seo done (3)'), ('x', 1, 'agent:geo started'), ('y', 4, 'agent:ux done (0)'), ('y', 5, 'hello'), ('y', 6, 'agent:seo done (12)')")


@query(
    f"""WITH {_MSGS_CTE}, l AS (SELECT id, regexp_extract(msg, '^agent:([a-z0-9-]+)', 1) AS agent, arg_max(msg, made) AS msg FROM msg WHERE msg LIKE 'agent:%' GROUP BY ALL)
    SELECT id, count(*) FILTER (contains(msg, 'done')) AS done, CAST(coalesce(sum(TRY_CAST(regexp_extract(msg, 'done \\((\\d+)\\)', 1) AS INTEGER)), 0) AS BIGINT) AS found, CAST(floor(100 * count(*) FILTER (contains(msg, 'done')) / 15.0 + 0.5) AS BIGINT) AS percent FROM l GROUP BY id"""
)
def progress_totals(spark, sf_dir):
    return quota.progress_totals(quota.progress(spark.sql(_MSGS).withColumnRenamed("made", "at")))


_QUOTA = "WITH w AS (SELECT event_id, user_id, ts, CAST(floor(epoch(ts) / 600) AS BIGINT) AS window_id FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id, window_id ORDER BY ts, event_id) AS r FROM w), p AS (SELECT event_id, row_number() OVER (PARTITION BY window_id ORDER BY ts, event_id) AS g FROM o WHERE r <= 5) SELECT o.event_id, o.window_id, o.r <= 5 AS user_ok, coalesce(g <= 60, false) AS allowed FROM o LEFT JOIN p ON p.event_id = o.event_id"


@query(_QUOTA)
def rate_limit_default(spark, sf_dir):
    return quota.admitted(table(spark, sf_dir, "events"))


# Answers: rules that the small fixture of answers leaves out.

_HDR, _HDR_CTE = values("hdr", "url, csp, hsts", "('https://a/', 'script-src ''self'' ''unsafe-eval''', 'max-age=10; includeSubDomains'), ('https://b/', 'default-src ''self''; script-src https://*.x.io', 'max-age=99999999'), ('https://c/', 'default-src ''self'' *', 'max-age=99999999; INCLUDESUBDOMAINS'), ('https://d/', CAST(NULL AS VARCHAR(9)), CAST(NULL AS VARCHAR(9))), ('http://e/', 'img-src x', 'max-age=10')")


@query(
    f"""WITH {_HDR_CTE}, c AS (SELECT url, coalesce(csp, '') AS csp, coalesce(hsts, '') AS hsts, coalesce(TRY_CAST(nullif(regexp_extract(hsts, 'max-age=(\\d+)', 1), '') AS BIGINT), 0) AS age FROM hdr)
    SELECT url, 'csp-no-default-src' AS rule FROM c WHERE csp <> '' AND csp NOT LIKE '%default-src%' UNION ALL SELECT url, 'csp-unsafe-inline' FROM c WHERE csp LIKE '%''unsafe-inline''%' UNION ALL SELECT url, 'csp-unsafe-eval' FROM c WHERE csp LIKE '%''unsafe-eval''%'
    UNION ALL SELECT url, 'csp-wildcard' FROM c WHERE regexp_matches(csp, 'script-src[^;]*\\*([^.]|$)') OR regexp_matches(csp, 'default-src[^;]*\\s\\*(\\s|;|$)') UNION ALL SELECT url, 'hsts-short-maxage' FROM c WHERE url LIKE 'https://%' AND age BETWEEN 1 AND 15767999
    UNION ALL SELECT url, 'hsts-no-subdomains' FROM c WHERE url LIKE 'https://%' AND hsts <> '' AND NOT (age BETWEEN 1 AND 15767999) AND lower(hsts) NOT LIKE '%includesubdomains%'"""
)
def policy_rules_fixture(spark, sf_dir):
    held = spark.sql(_HDR).select("url", F.map_from_arrays(F.array(F.lit("content-security-policy"), F.lit("strict-transport-security")), F.array("csp", "hsts")).alias("headers"), F.lit(None).cast("string").alias("probe_origin"))
    return response_rules.policy_findings(held)


@query(f"WITH {_HDR_CTE} SELECT url, 'missing-hsts' AS rule FROM hdr WHERE hsts IS NULL AND url LIKE 'https://%'")
def missing_hsts(spark, sf_dir):
    held = spark.sql(_HDR).select("url", F.map_from_arrays(F.array(F.lit("strict-transport-security")), F.array("hsts")).alias("headers"))
    return response_rules.header_findings(held).where("rule = 'missing-hsts'")


_EXPOSED = {
    "/.env": ("exposed--env", "critical", "DB_PASS=x", "hello"),
    "/.env.local": ("exposed--env-local", "critical", "A_B=1", "a=1"),
    "/.env.production": ("exposed--env-production", "critical", "KEY=", "no"),
    "/.git/config": ("exposed--git-config", "high", "[core]", "core"),
    "/.git/HEAD": ("exposed--git-HEAD", "high", "ref:  refs/heads/x", "refs"),
    "/.aws/credentials": ("exposed--aws-credentials", "critical", "AWS_ACCESS_KEY_ID = x", "x"),
    "/config.json": ("exposed-config-json", "medium", "{}", "[]"),
    "/.DS_Store": ("exposed--DS-Store", "low", "..Bud1..", "x"),
    "/backup.sql": ("exposed-backup-sql", "high", "create table t", "select 1"),
    "/server-status": ("exposed-server-status", "medium", "Server uptime: 1", "ok"),
}
_EXP, _EXP_CTE = values("exps", "base, path, status, body, rule, severity", ", ".join(f"('{b}', '{p}', {s}, '{x}', '{r}', '{v}')" for p, (r, v, good, bad) in _EXPOSED.items() for b, s, x in (("yes", 200, good), ("no", 200, bad), ("gone", 404, good))))


@query(f"WITH {_EXP_CTE} SELECT base, path, rule, severity FROM exps WHERE base = 'yes'")
def exposed_fixture(spark, sf_dir):
    return response_rules.exposed_findings(spark.sql(_EXP).drop("rule", "severity"))


_ROBOTS = ("GPTBot", "OAI-SearchBot", "PerplexityBot", "ClaudeBot", "Google-Extended")
_BOT, _BOT_CTE = values("bots", "site, body, bot", ", ".join(f"('{b}-{i}', concat('User-agent: {b}', chr(10), 'Disallow: {p}', chr(10)), '{b}')" for b in _ROBOTS for i, p in enumerate(("/", "/private", ""))))


@query(f"WITH {_BOT_CTE} SELECT site, concat('blocks-', bot) AS rule FROM bots WHERE site LIKE '%-0'")
def robots_fixture(spark, sf_dir):
    return response_rules.blocked_bots(spark.sql(_BOT).drop("bot"))
