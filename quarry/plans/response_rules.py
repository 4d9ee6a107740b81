"""Rules over what a server answers: headers, cookies, probes, names and certificates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headers that should be there, directives that weaken a policy, files that should not be served.
HEADERS = (("missing-csp", "content-security-policy"), ("missing-hsts", "strict-transport-security"), ("missing-xcto", "x-content-type-options"), ("missing-frame", "x-frame-options"), ("missing-referrer", "referrer-policy"), ("missing-permissions-policy", "permissions-policy"))
WILDCARD = r"(script-src[^;]*\*(?!\.)|default-src[^;]*\s\*(?:\s|;|$))"
EXPOSED = (
    ("/.env", "critical", "[A-Z_]+="),
    ("/.env.local", "critical", "[A-Z_]+="),
    ("/.env.production", "critical", "[A-Z_]+="),
    ("/.git/config", "high", r"\[core\]|repositoryformatversion"),
    ("/.git/HEAD", "high", r"ref:\s*refs/"),
    ("/.aws/credentials", "critical", "(?i)aws_access_key_id"),
    ("/config.json", "medium", "[{]"),
    ("/.DS_Store", "low", r"Bud1|\x00\x00\x00"),
    ("/backup.sql", "high", "(?i)(CREATE TABLE|INSERT INTO|DROP TABLE)"),
    ("/server-status", "medium", "(?i)Apache Server Status|Server uptime"),
)
BOTS = ("GPTBot", "OAI-SearchBot", "PerplexityBot", "ClaudeBot", "Google-Extended")
TRACKING_COOKIE = "(?i)_ga|_gid|_fbp|_gcl|hjSession|amplitude|mp_"
HSTS_LEAST = 15_768_000
MIXED = r"(?i)<(?:script|img|iframe|link|source|video|audio)(?![0-9A-Za-z_])[^>]*(?<![0-9A-Za-z_])(?:src|href)=[\"']http://[^\"']+"


def header(name: str) -> Column:
    """A response's header, empty where there is none."""
    return F.coalesce(F.try_element_at("headers", F.lit(name)), F.lit(""))


def _explode(responses: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(when, F.lit(name)) for name, when in rules]))
    return responses.select("url", F.explode(found).alias("rule"))


def header_findings(responses: DataFrame) -> DataFrame:
    """url, rule of missing and telling headers; responses: url, headers (map)."""
    https = F.startswith("url", F.lit("https://"))
    rules = []
    for name, wanted in HEADERS:
        missing = header(wanted) == ""
        if name == "missing-hsts":
            missing = missing & https
        if name == "missing-frame":
            missing = missing & ~F.contains(F.lower(header("content-security-policy")), F.lit("frame-ancestors"))
        rules.append((name, missing))
    rules += [("server-version", header("server").rlike(r"\d")), ("powered-by", header("x-powered-by") != ""), ("no-tls", ~https), ("no-compression", ~header("content-encoding").rlike("(?i)gzip|br|zstd")), ("weak-cache", (header("cache-control") == "") | header("cache-control").rlike("(?i)no-store|no-cache"))]
    return _explode(responses, rules)


def policy_findings(responses: DataFrame) -> DataFrame:
    """url, rule of weak content security policies, HSTS and CORS answers."""
    csp, hsts = header("content-security-policy"), header("strict-transport-security")
    age = F.coalesce(F.regexp_extract(hsts, r"(?i)max-age=(\d+)", 1).try_cast("bigint"), F.lit(0))
    secure = F.startswith("url", F.lit("https://")) & (hsts != "")
    short = (age > 0) & (age < HSTS_LEAST)
    origin, trusted = header("access-control-allow-origin"), F.lower(header("access-control-allow-credentials")) == "true"
    return _explode(
        responses,
        [
            ("csp-no-default-src", (csp != "") & ~csp.rlike(r"(?i)(^|;)\s*default-src")),
            ("csp-unsafe-inline", F.contains(csp, F.lit("'unsafe-inline'"))),
            ("csp-unsafe-eval", F.contains(csp, F.lit("'unsafe-eval'"))),
            ("csp-wildcard", csp.rlike(WILDCARD)),
            ("hsts-short-maxage", secure & short),
            ("hsts-no-subdomains", secure & ~short & ~hsts.rlike("(?i)includesubdomains")),
            ("cors-reflected-origin", (origin == F.coalesce(F.col("probe_origin"), F.lit("\0"))) | ((origin == "*") & trusted)),
        ],
    )


def cookie_findings(cookies: DataFrame) -> DataFrame:
    """url, cookie, missing (attributes, joined), tracking; cookies: url, cookie."""
    low = F.lower("cookie")
    missing = F.array_compact(F.array(F.when(F.startswith("url", F.lit("https://")) & ~F.contains(low, F.lit("secure")), F.lit("Secure")), F.when(~F.contains(low, F.lit("httponly")), F.lit("HttpOnly")), F.when(~F.contains(low, F.lit("samesite")), F.lit("SameSite"))))
    return cookies.select("url", F.regexp_extract("cookie", "^([^=]*)", 1).alias("cookie"), F.array_join(missing, "/").alias("missing"), F.col("cookie").rlike(TRACKING_COOKIE).alias("tracking"))


def exposed_findings(probes: DataFrame) -> DataFrame:
    """base, path, rule, severity of sensitive files that were served; probes: base, path, status, body."""
    rule = lambda p: F.lit("exposed" + "".join(c if c.isalpha() else "-" for c in p))
    body = F.substring(F.coalesce("body", F.lit("")), 1, 4000)
    found = F.coalesce(*[F.when((F.col("path") == p) & body.rlike(must), F.struct(rule(p).alias("rule"), F.lit(s).alias("severity"))) for p, s, must in EXPOSED])
    return probes.where(F.col("status").between(200, 299)).select("base", "path", found.alias("f")).where("f is not null").select("base", "path", "f.*")


def blocked_bots(robots: DataFrame) -> DataFrame:
    """site, rule for each assistant's crawler that robots.txt shuts out; robots: site, body."""
    body = F.substring(F.coalesce("body", F.lit("")), 1, 4000)
    found = F.array_compact(F.array(*[F.when(body.rlike(rf"(?i)User-agent:\s*{b}[\s\S]*?Disallow:\s*/\s*(?:\n|$)"), F.lit(f"blocks-{b}")) for b in BOTS]))
    return robots.select("site", F.explode(found).alias("rule"))


def mail_findings(dns: DataFrame) -> DataFrame:
    """domain, rule; dns: domain, kind (txt, dmarc, mx, dkim), ok, answers. A query that failed proves nothing."""
    of = lambda kind: F.col("kind") == kind
    some = lambda p: F.get(F.filter("answers", lambda a: a.rlike(p)), F.lit(0))
    by = dns.groupBy("domain").agg(
        F.bool_or(F.when(of("txt"), F.col("ok"))).alias("txt_ok"),
        F.max(F.when(of("txt"), some("(?i)v=spf1"))).alias("spf"),
        F.bool_or(F.when(of("dmarc"), F.col("ok"))).alias("dmarc_ok"),
        F.max(F.when(of("dmarc"), some("(?i)v=DMARC1"))).alias("dmarc"),
        F.bool_or(F.when(of("mx"), F.col("ok") & (F.size("answers") > 0))).alias("mail"),
        F.bool_or(F.when(of("dkim"), F.col("ok"))).alias("dkim_ok"),
        F.bool_or(F.when(of("dkim"), F.col("ok") & some("(?i)v=DKIM1|p=[A-Za-z0-9+/]").isNotNull())).alias("dkim"),
    )
    no = lambda c: ~F.coalesce(c, F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rules = [
        ("no-spf", yes("txt_ok") & F.col("spf").isNull()),
        ("weak-spf", yes("txt_ok") & F.coalesce(F.col("spf").rlike("(?i)[?~]all") & ~F.col("spf").rlike("(?i)-all"), F.lit(False))),
        ("no-dmarc", yes("dmarc_ok") & F.col("dmarc").isNull()),
        ("dmarc-none", yes("dmarc_ok") & F.coalesce(F.col("dmarc").rlike("(?i)p=none"), F.lit(False))),
        ("dns-uncheckable", no(F.col("txt_ok")) & no(F.col("dmarc_ok"))),
        ("no-dkim", yes("mail") & yes("dkim_ok") & no(F.col("dkim"))),
    ]
    return by.select("domain", F.explode(F.array_compact(F.array(*[F.when(w, F.lit(n)) for n, w in rules]))).alias("rule"))


def certificate_findings(certs: DataFrame, today: str = "2026-07-19") -> DataFrame:
    """host, days, rule of certificates that end within 21 days; certs: host, valid_to (timestamp)."""
    days = F.floor((F.unix_seconds(F.col("valid_to").cast("timestamp")) - F.unix_seconds(F.lit(today).cast("timestamp"))) / 86400 + 0.5)
    return certs.select("host", days.cast("long").alias("days")).withColumn("rule", F.when(F.col("days") < 0, "cert-expired").when(F.col("days") < 21, "cert-expiring")).where(F.col("rule").isNotNull())


def stack(responses: DataFrame) -> DataFrame:
    """url, tech: what a response tells of the software behind it; responses: url, headers, body."""
    server, body = header("server"), F.coalesce("body", F.lit(""))
    signs = [
        F.nullif(F.get(F.split(server, "/"), F.lit(0)), F.lit("")),
        F.nullif(header("x-powered-by"), F.lit("")),
        F.when((header("x-vercel-id") != "") | server.rlike("(?i)vercel"), "Vercel"),
        F.when((header("x-nf-request-id") != "") | server.rlike("(?i)netlify"), "Netlify"),
        F.when(server.rlike("(?i)cloudflare"), "Cloudflare"),
        F.when(body.rlike("(?i)wp-content|wp-includes"), "WordPress"),
        F.when(body.rlike("__NEXT_DATA__|/_next/"), "Next.js"),
        F.when(body.rlike('id="__nuxt"|/_nuxt/'), "Nuxt"),
        F.when(body.rlike("(?i)data-reactroot|react") & body.rlike(r"\.js"), "React"),
        F.when(body.rlike("ng-version="), "Angular"),
        F.when(body.rlike("data-v-[0-9a-f]{8}"), "Vue"),
        F.when(body.rlike(r"(?i)gtag\(|googletagmanager"), "Google Tag Manager"),
        F.when(body.rlike(r"Shopify\.") | (header("x-shopid") != ""), "Shopify"),
    ]
    return responses.select("url", F.array_join(F.array_distinct(F.array_compact(F.array(*[s.cast("string") for s in signs]))), ",").alias("tech"))
