"""SQL, written by hand from the rules' descriptions, that finds the same rows in another engine.

Nothing here is derived from the columns that the operators make: a wrong
pattern on one side shows as a difference.  Patterns have no look-around.
"""

from __future__ import annotations

#: What the page rules look at, of a relation `pages`.
FACTS = r"""
    base AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
    bare AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(html, '(?i)<script[\s\S]*?</script>', ' ', 'g'), '(?i)<style[\s\S]*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS bare FROM base),
    facts AS (
      SELECT page_id, url, html,
        nullif(regexp_replace(regexp_extract(html, '(?i)<title\b[^>]*>([\s\S]*?)</title>', 1), '^\s+|\s+$', '', 'g'), '') AS title,
        coalesce(nullif(trim(regexp_extract(html, '(?i)<meta\b[^>]*name\s*=\s*["'']description["''][^>]*content\s*=\s*["'']([^"'']*)["'']', 1)), ''),
                 nullif(trim(regexp_extract(html, '(?i)<meta\b[^>]*content\s*=\s*["'']([^"'']*)["''][^>]*name\s*=\s*["'']description["'']', 1)), '')) AS descr,
        CAST(len(regexp_extract_all(html, '(?i)<h1\b')) AS INTEGER) AS h1,
        nullif(regexp_extract(html, '(?i)<link\b[^>]*rel\s*=\s*["'']canonical["''][^>]*href\s*=\s*["'']([^"'']*)["'']', 1), '') AS canonical,
        regexp_matches(html, '(?i)<meta\b[^>]*name\s*=\s*["'']robots["''][^>]*noindex') AS noindex,
        CAST(len(regexp_extract_all(bare, '\S+')) AS INTEGER) AS words,
        trim(regexp_replace(regexp_replace(bare, '(?i)&[a-z#0-9]+;', ' ', 'g'), '\s+', ' ', 'g')) AS text,
        regexp_split_to_array(html, '(?i)</head>')[1] AS head,
        regexp_split_to_array(html, '(?i)</header>')[1] AS header,
        strip_accents(lower(html)) AS folded,
        array_to_string(regexp_extract_all(html, '(?i)<label\b[^>]*>[\s\S]*?</label>'), chr(10)) AS labels,
        coalesce(list_max(list_transform(regexp_split_to_array(html, '(?i)<form\b')[2:], lambda f: len(regexp_extract_all(regexp_split_to_array(f, '(?i)</form>')[1], '(?i)<input\b|<select\b|<textarea\b')))), 0) AS most_fields,
        length(regexp_replace(regexp_replace(regexp_extract(html, '(?i)<h1\b[^>]*>([\s\S]*?)</h1>', 1), '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g')) AS h1_chars
      FROM bare
    ),
    known AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(text, '(?i)(?:©|copyright|\bcopy\b)[^0-9]{0,10}(20\d{2})', 1), '') AS INTEGER), 0) AS copyright FROM facts)
"""

# Agent, rule, severity, effort, verdict, kind and condition of each page rule.
PAGE_RULES = r"""
seo | missing-title | high | 0.2 | confirmed | risk | title IS NULL
seo | missing-meta-desc | medium | 0.3 | confirmed | risk | descr IS NULL
seo | missing-h1 | medium | 0.3 | confirmed | risk | h1 = 0
seo | multiple-h1 | low | 0.3 | plausible | risk | h1 >= 2
seo | missing-canonical | medium | 0.2 | confirmed | risk | canonical IS NULL
seo | noindex-pages | low | 0.2 | plausible | risk | noindex
seo | thin-content | info | 0.5 | plausible | risk | words BETWEEN 1 AND 119
seo | missing-viewport | high | 0.1 | confirmed | risk | len(list_filter(metas, lambda m: regexp_matches(m, '(?i)name=["'']viewport') AND regexp_matches(m, '(?i)\bcontent\s*=\s*["'']'))) = 0
seo | missing-og | low | 0.2 | confirmed | risk | len(list_filter(metas, lambda m: regexp_matches(m, '(?i)property=["'']og:title') AND regexp_matches(m, '(?i)\bcontent\s*=\s*["'']'))) = 0
seo | no-structured-data | low | 0.4 | confirmed | risk | NOT contains(lower(html), 'application/ld+json')
geo | no-jsonld-geo | medium | 0.4 | confirmed | risk | NOT contains(lower(html), 'application/ld+json')
geo | no-qa-structure | low | 0.5 | confirmed | risk | length(text) > 400 AND NOT regexp_matches(text, '(?i)\b(qu''est-ce|comment|pourquoi|what is|how to|why)\b') AND NOT regexp_matches(html, '(?i)<h[23][^>]*>[^<]*\?')
geo | weak-eeat | low | 0.5 | confirmed | risk | length(text) > 800 AND NOT regexp_matches(html, '(?i)author|auteur')
perf | heavy-html | medium | 0.4 | confirmed | gain | strlen(html) > 150000
perf | render-blocking-js | medium | 0.3 | confirmed | gain | len(list_filter(regexp_extract_all(head, '(?i)<script\b[^>]*>'), lambda x: regexp_matches(x, '(?i)src=') AND NOT regexp_matches(x, '(?i)defer|async|type=["'']module["'']'))) > 0
perf | many-css | low | 0.3 | confirmed | gain | len(list_filter(regexp_extract_all(head, '(?i)<link\b[^>]*>'), lambda x: regexp_matches(x, '(?i)rel=["'']stylesheet["'']'))) > 4
perf | img-no-dims | low | 0.3 | confirmed | gain | len(list_filter(imgs, lambda x: NOT (regexp_matches(x, '(?i)\bwidth\s*=\s*["''][^"'']*["'']') AND regexp_matches(x, '(?i)\bheight\s*=\s*["''][^"'']*["'']')))) > 0
perf | no-lazy | low | 0.2 | confirmed | gain | len(imgs) > 5 AND len(list_filter(imgs, lambda x: regexp_matches(x, '(?i)loading=["'']lazy["'']'))) = 0
a11y | no-lang | medium | 0.1 | confirmed | risk | NOT regexp_matches(html, '(?i)<html[^>]*\blang\s*=')
a11y | img-no-alt | high | 0.3 | confirmed | risk | len(list_filter(imgs, lambda x: NOT regexp_matches(x, '(?i)\balt\s*=\s*["''][^"'']*["'']'))) > 0
a11y | input-no-label | high | 0.4 | confirmed | risk | len(list_filter(regexp_extract_all(html, '(?i)<input\b[^>]*>'), lambda x: NOT contains(labels, x) AND NOT regexp_matches(x, '(?i)type=["''](hidden|submit|button|image)["'']') AND NOT regexp_matches(x, '(?i)\b(aria-label|aria-labelledby|title|id|placeholder)\s*=\s*["''][^"'']*["'']'))) > 0
a11y | heading-order | medium | 0.2 | confirmed | risk | h1 = 0 AND regexp_matches(html, '(?i)<h2\b')
a11y | empty-link | medium | 0.3 | confirmed | risk | len(list_filter(regexp_extract_all(html, '(?i)<a\b[^>]*>([\s\S]*?)</a>', 1), lambda x: NOT regexp_matches(regexp_replace(x, '<[^>]+>', '', 'g'), '\S'))) > 0
a11y | button-no-aria | low | 0.3 | confirmed | risk | len(regexp_extract_all(html, '(?i)<button\b[^>]*>')) >= 3 AND len(list_filter(regexp_extract_all(html, '(?i)<button\b[^>]*>'), lambda x: regexp_matches(x, '(?i)\baria-label\s*=\s*["'']'))) = 0
a11y | no-zoom | medium | 0.1 | confirmed | risk | regexp_matches(html, '(?i)user-scalable\s*=\s*no') OR regexp_matches(html, '(?i)maximum-scale\s*=\s*1(?:\.0)?\b')
a11y | positive-tabindex | low | 0.3 | confirmed | risk | regexp_matches(html, '(?i)tabindex\s*=\s*["'']?[1-9]')
legal | tracker-no-cmp | high | 0.6 | confirmed | risk | regexp_matches(html, '(?i)googletagmanager|gtag\(|google-analytics|analytics\.js|connect\.facebook\.net|fbq\(|hotjar|hj\(|clarity\.ms|doubleclick|adservice\.google') AND NOT consent
legal | no-privacy-link | medium | 0.3 | plausible | risk | NOT regexp_matches(folded, 'politique de confidentialite|privacy policy|donnees personnelles|\brgpd\b|\bgdpr\b') AND NOT regexp_matches(html, '(?i)href=["''][^"'']*(privacy|confidentialite|politique-de-confidentialite|donnees-personnelles)')
legal | no-legal-notice | medium | 0.3 | plausible | risk | NOT regexp_matches(folded, 'mentions legales|legal notice|impressum|conditions generales|terms of service|\bcgv\b|\bcgu\b') AND NOT regexp_matches(html, '(?i)href=["''][^"'']*(mentions-legales|/cgv|/cgu|/legal|mentions_legales)')
analytics | no-analytics | low | 0.3 | plausible | risk | NOT (ga4 OR gtm OR ua OR consent) AND NOT regexp_matches(html, '(?i)rgpd|gdpr|\bgtag\b|\bdataLayer\b|GTM-|G-[A-Z0-9]{6,}|plausible|matomo|piwik|fathom|segment\.com|mixpanel|posthog|umami|clarity\.ms|analytics')
analytics | legacy-ua | high | 0.5 | confirmed | risk | ua AND NOT ga4
analytics | double-tagging | medium | 0.3 | confirmed | risk | ga4 AND gtm
analytics | no-consent-mode | medium | 0.4 | confirmed | risk | (ga4 OR gtm) AND NOT regexp_matches(html, '(?i)consent["'']?\s*,\s*["''](default|update)|gcs=|consent_mode')
ux | long-form | medium | 0.4 | confirmed | risk | most_fields > 7
ux | tiny-font | low | 0.2 | confirmed | risk | regexp_matches(html, '(?i)font-size\s*:\s*([0-9]|10|11)px')
ux | nav-overload | low | 0.3 | confirmed | risk | len(regexp_extract_all(header, '(?i)<a\b')) > 9
ux | thin-page | medium | 0.5 | confirmed | risk | length(text) < 200
ux | no-favicon | info | 0.1 | confirmed | risk | NOT regexp_matches(html, '(?i)rel=["''](icon|shortcut icon|apple-touch-icon)["'']')
cro | no-cta | high | 0.4 | confirmed | gain | calls = 0
cro | weak-value-prop | medium | 0.4 | confirmed | gain | h1_chars < 8
cro | no-social-proof | low | 0.5 | confirmed | gain | NOT regexp_matches(text, '(?i)avis|temoignage|review|testimonial|note|etoiles|clients|utilisateurs|trusted|ils nous font confiance|\d+\s*users')
cro | cta-overload | low | 0.3 | confirmed | gain | calls > 6
content | unresolved-i18n | high | 0.3 | confirmed | risk | regexp_matches(text, '(?i)\b[a-z][a-z0-9]*([._][a-z0-9]+)*\.(title|label|description|cta|button|heading|subtitle)\b')
content | stale-copyright | low | 0.1 | confirmed | risk | copyright BETWEEN 1 AND 2024
content | lang-mismatch | medium | 0.4 | confirmed | risk | regexp_matches(html, '(?i)<html[^>]*\blang\s*=\s*["'']fr[a-z-]*["'']') AND english > 8 AND english > french
""".strip().splitlines()
PAGE_RULES = [[x.strip() for x in line.split(" | ", 6)] for line in PAGE_RULES]

SEEN = r"""
    seen AS (SELECT *, regexp_extract_all(html, '(?i)<meta\b[^>]*>') AS metas, regexp_extract_all(html, '(?i)<img\b[^>]*>') AS imgs,
      regexp_matches(html, '(?i)cookie|consent|cmp|didomi|axeptio|tarteaucitron|cookiebot|onetrust') AS consent,
      regexp_matches(html, '(?i)gtag\(\s*["'']config["'']\s*,\s*["'']G-|googletagmanager\.com/gtag/js\?id=G-') AS ga4,
      regexp_matches(html, '(?i)googletagmanager\.com/gtm\.js|GTM-[A-Z0-9]+') AS gtm, regexp_matches(html, '(?i)UA-\d{4,}-\d+|analytics\.js') AS ua,
      len(list_filter(list_concat(regexp_extract_all(html, '(?i)<a\b[^>]*>([\s\S]*?)</a>', 1), regexp_extract_all(html, '(?i)<button\b[^>]*>([\s\S]*?)</button>', 1)), lambda x: regexp_matches(regexp_replace(x, '<[^>]+>', ' ', 'g'),
        '(?i)acheter|commander|s''inscrire|essayer|demander|reserver|contact|devis|demarrer|get started|sign up|buy|try|book|start|subscribe|telecharger|download'))) AS calls,
      len(regexp_extract_all(text, '(?i)\b(the|and|your|for|with|from|about|price|features)\b')) AS english, len(regexp_extract_all(text, '(?i)\b(le|la|les|des|vous|pour|avec|votre|prix)\b')) AS french
      FROM known)
"""
PAGES = f"{FACTS.rstrip()},{SEEN}"


def page_verdicts(agent: str) -> str:
    """page_id and one boolean for each rule of an agent."""
    rules = ", ".join(f"({when}) AS {rule.replace('-', '_')}" for own, rule, *_, when in PAGE_RULES if own == agent)
    return f"WITH {PAGES} SELECT page_id, {rules} FROM seen"


def page_findings() -> str:
    """page_id, url, agent, rule, severity, effort, verdict, kind, emit_seq of each rule that a page breaks."""
    parts = [f"SELECT page_id, url, '{agent}' AS agent, '{rule}' AS rule, '{severity}' AS severity, CAST({effort} AS DOUBLE) AS effort, '{verdict}' AS verdict, '{kind}' AS kind, {i} AS emit_seq FROM seen WHERE {when}" for i, (agent, rule, severity, effort, verdict, kind, when) in enumerate(PAGE_RULES)]
    return f"WITH {PAGES} " + " UNION ALL ".join(parts)


# Rule, severity, languages, and one or two patterns of each line rule; a line must match the first and not the second.
SECRET_LINES = r"""
stripe-secret-live | critical | - | \bsk_live_[0-9a-zA-Z]{20,}
stripe-restricted-live | critical | - | \brk_live_[0-9a-zA-Z]{20,}
aws-access-key | critical | - | \b(AKIA|ASIA)[0-9A-Z]{16}\b
google-api-key | high | - | \bAIza[0-9A-Za-z\-_]{35}\b
github-token | critical | - | \b(ghp|gho|ghu|ghs|ghr)_[0-9A-Za-z]{36}\b|\bgithub_pat_[0-9A-Za-z_]{22,}
slack-token | high | - | \bxox[baprs]-[0-9A-Za-z-]{10,}
sendgrid-key | high | - | \bSG\.[0-9A-Za-z_-]{22}\.[0-9A-Za-z_-]{43}\b
openai-key | high | - | \bsk-(proj-)?[0-9A-Za-z_-]{20,}
private-key | critical | - | -----BEGIN (RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----
jwt-hardcoded | medium | - | \beyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}
generic-secret-assign | medium | - | (?i)\b(api[_-]?key|secret|token|passwd|password|client[_-]?secret|auth[_-]?token)\b\s*[:=]\s*['"][^'"\s]{16,}['"]
"""
CODE_LINES = r"""
js-eval | high | js ts | \beval\s*\(|new\s+Function\s*\(
js-inner-html | high | js ts html | \.(inner|outer)HTML\s*\+?=\s*[A-Za-z_$]
react-dangerous-html | high | jsx tsx js ts | dangerouslySetInnerHTML\s*=\s*\{\{[^}]*\b
js-document-write | medium | js ts html | document\.write(ln)?\s*\(
cmd-injection | critical | js ts | \b(exec|execSync|spawn|spawnSync)\s*\(\s*[`'"][^`'"]*\$\{|\b(exec|execSync)\s*\([^)]*\+
sql-injection | critical | js ts py php | (?i)(SELECT|INSERT|UPDATE|DELETE|WHERE|FROM)\b[^;`'"]*(`[^`]*\$\{|['"]\s*\+\s*[A-Za-z_$])
weak-hash | medium | js ts py | (?i)createHash\s*\(\s*['"](md5|sha1)['"]|hashlib\.(md5|sha1)\s*\(
weak-cipher | high | js ts | \b(createCipher|createDecipher)\s*\(
tls-disabled | high | js ts | rejectUnauthorized\s*:\s*false|NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['"]?0
cors-wildcard | medium | js ts | Access-Control-Allow-Origin['"]?\s*[:,]\s*['"]\*['"]
insecure-random | medium | js ts | (?i)\b(token|secret|nonce|otp|password|salt|apikey|api_key)\b[^;\n]*Math\.random\s*\(
cleartext-http | medium | js ts py php env | (?i)['"]http://[^'"\s]+(api|auth|login|token|pay)[^'"\s]* | (?i)['"]http://(localhost|127\.0\.0\.1|0\.0\.0\.0)
py-insecure-deser | high | py | \bpickle\.loads?\s*\(|\byaml\.load\s*\( | ^[^p]*\byaml\.load\s*\([^)]*Loader\s*=\s*yaml\.SafeLoader
py-shell-true | high | py | subprocess\.(call|run|Popen|check_output)\s*\([^)]*shell\s*=\s*True|\bos\.system\s*\(
"""
DATA_LINES = r"""
select-star | low | - | (?i)\bSELECT\s+\*\s+FROM\b
no-limit | info | - | (?i)\.(find|findAll|query)\([^)]*\) | (?i)\.(find|findAll|query)\([^)]*limit
"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def line_findings(source: str, rules: str) -> str:
    """file, n, rule, severity of a relation (file, n, line, lang)."""
    parts = []
    for text in rules.strip().splitlines():
        rule, severity, langs, find, *but = [x.strip() for x in text.split(" | ")]
        where = f"regexp_matches(line, {quoted(find)})"
        if langs != "-":
            where += f" AND (lang IS NULL OR lang IN ({', '.join(map(quoted, langs.split()))}))"
        if but:
            where += f" AND NOT regexp_matches(line, {quoted(but[0])})"
        parts.append(f"SELECT file, n, '{rule}' AS rule, '{severity}' AS severity FROM {source} WHERE {where}")
    return " UNION ALL ".join(parts)


def suppressed(source: str) -> str:
    """A common table expression `kept`: the lines that aren't suppressed and aren't too long."""
    return f"kept AS (SELECT * FROM (SELECT *, lag(contains(lower(line), 'audit-ignore')) OVER (PARTITION BY file ORDER BY n) AS after FROM {source}) WHERE NOT contains(lower(line), 'audit-ignore') AND NOT coalesce(after, false) AND length(line) <= 2000)"
