"""The catalogue of page rules: one predicate each, all evaluated in one scan of the pages."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from quarry.functions.html import facts, opening, visible_text
from quarry.plans.expr import Term, elements, has, inner, java, length, octets, times


@dataclass(frozen=True)
class Rule:
    agent: str
    id: str
    severity: str
    effort: float
    when: Term
    plausible: bool = False
    gain: int = 0
    risk: int = 0


def null_or_empty(column: str) -> Term:
    return Term(lambda: F.col(column).isNull())


def number(column: str) -> Term:
    return Term(lambda: F.col(column))


def true(column: str) -> Term:
    return Term(lambda: F.col(column))


# The patterns from here to RULES, those in RULES, COPYRIGHT and FORM_FIELDS decide which pages a rule finds.
LD_JSON = has("html", r"(?i)application/ld\+json")
QUESTIONS = has("text", r"(?i)\b(qu'est-ce|comment|pourquoi|what is|how to|why)\b", ("qu'est-ce", "comment", "pourquoi", "what is", "how to", "why")) | has("html", r"(?i)<h[23][^>]*>[^<]*\?")
TRACKERS = (r"(?i)googletagmanager|gtag\(|google-analytics|analytics\.js", r"(?i)connect\.facebook\.net|fbq\(", r"(?i)hotjar|hj\(", r"(?i)clarity\.ms", r"(?i)doubleclick|adservice\.google")
CONSENT = r"(?i)cookie|consent|cmp|didomi|axeptio|tarteaucitron|cookiebot|onetrust"
GA4 = has("html", r"(?i)gtag\(\s*['\"]config['\"]\s*,\s*['\"]G-|googletagmanager\.com/gtag/js\?id=G-", ("gtag(",))
GTM = has("html", r"(?i)googletagmanager\.com/gtm\.js|GTM-[A-Z0-9]+", ("gtm-",))
OLD_UA = has("html", r"(?i)UA-\d{4,}-\d+|analytics\.js", ("ua-",))
HINT = has("html", r"(?i)\bgtag\b|\bdataLayer\b|GTM-|G-[A-Z0-9]{6,}|plausible|matomo|piwik|fathom|segment\.com|mixpanel|posthog|umami|clarity\.ms|analytics", ("gtag", "datalayer", "g-"))
CONSENT_MODE = has("html", r"(?i)consent['\"]?\s*,\s*['\"](default|update)|gcs=|consent_mode", ("consent",))
PRIVACY = has("folded", r"politique de confidentialite|privacy policy|donnees personnelles|\brgpd\b|\bgdpr\b", ("rgpd", "gdpr")) | has("html", r"(?i)href=[\"'][^\"']*(privacy|confidentialite|politique-de-confidentialite|donnees-personnelles)", ("privacy", "confidentialite", "donnees-personnelles"))
LEGAL = has("folded", r"mentions legales|legal notice|impressum|conditions generales|terms of service|\bcgv\b|\bcgu\b", ("cgv", "cgu")) | has("html", r"(?i)href=[\"'][^\"']*(mentions-legales|/cgv|/cgu|/legal|mentions_legales)", ("mentions-legales", "/cgv", "/cgu", "/legal", "mentions_legales"))
CALL = r"(?i)(acheter|commander|s'inscrire|essayer|demander|reserver|contact|devis|demarrer|get started|sign up|buy|try|book|start|subscribe|telecharger|download)"
PROOF = has("text", r"(?i)avis|temoignage|review|testimonial|note|etoiles|clients|utilisateurs|trusted|ils nous font confiance|\d+\s*(?:avis|clients|users)", ("avis", "clients", "users"))
RAW_KEY = r"(?i)\b[a-z][a-z0-9]*(?:[._][a-z0-9]+)*\.(?:title|label|description|cta|button|heading|subtitle)\b"
ENGLISH = r"(?i)\b(the|and|your|for|with|from|about|price|features)\b"
FRENCH = r"(?i)\b(le|la|les|des|vous|pour|avec|votre|prix)\b"


def any_of(*terms: Term) -> Term:
    out = terms[0]
    for t in terms[1:]:
        out = out | t
    return out


CALLS = inner("html", ("a", "button"), CALL, " ")

RULES = (
    Rule("seo", "missing-title", "high", 0.2, null_or_empty("title")),
    Rule("seo", "missing-meta-desc", "medium", 0.3, null_or_empty("descr")),
    Rule("seo", "missing-h1", "medium", 0.3, number("h1").equals(0)),
    Rule("seo", "multiple-h1", "low", 0.3, number("h1") > 1, plausible=True),
    Rule("seo", "missing-canonical", "medium", 0.2, null_or_empty("canonical")),
    Rule("seo", "noindex-pages", "low", 0.2, true("noindex"), plausible=True),
    Rule("seo", "thin-content", "info", 0.5, (number("words") > 0) & (number("words") < 120), plausible=True),
    Rule("seo", "missing-viewport", "high", 0.1, elements("html", "meta", yes=(r"(?i)name=[\"']viewport", r"(?i)\bcontent\s*=\s*[\"']")).equals(0)),
    Rule("seo", "missing-og", "low", 0.2, elements("html", "meta", yes=(r"(?i)property=[\"']og:title", r"(?i)\bcontent\s*=\s*[\"']")).equals(0)),
    Rule("seo", "no-structured-data", "low", 0.4, ~LD_JSON),
    Rule("geo", "no-jsonld-geo", "medium", 0.4, ~LD_JSON),
    Rule("geo", "no-qa-structure", "low", 0.5, (length("text") > 400) & ~QUESTIONS),
    Rule("geo", "weak-eeat", "low", 0.5, ~has("html", r"(?i)author|auteur|rel=[\"']author[\"']", ("author",)) & (length("text") > 800)),
    Rule("perf", "heavy-html", "medium", 0.4, octets("html") > 150000, gain=2000),
    Rule("perf", "render-blocking-js", "medium", 0.3, elements("head", "script", yes=(r"(?i)src=",), no=(r"(?i)defer|async|type=[\"']module[\"']",)) > 0, gain=1800),
    Rule("perf", "many-css", "low", 0.3, elements("head", "link", yes=(r"(?i)rel=[\"']stylesheet[\"']",)) > 4, gain=600),
    Rule("perf", "img-no-dims", "low", 0.3, elements("html", "img", missing=("width", "height")) > 0, gain=700),
    Rule("perf", "no-lazy", "low", 0.2, (elements("html", "img") > 5) & elements("html", "img", yes=(r"(?i)loading=[\"']lazy[\"']",)).equals(0), gain=500),
    Rule("a11y", "no-lang", "medium", 0.1, ~has("html", r"(?i)<html[^>]*\blang\s*=")),
    Rule("a11y", "img-no-alt", "high", 0.3, elements("html", "img", missing=("alt",)) > 0),
    Rule("a11y", "input-no-label", "high", 0.4, elements("html", "input", outside="labels", no=(r"(?i)type=[\"'](hidden|submit|button|image)[\"']", *(rf"(?i)\b{a}\s*=\s*[\"'][^\"']*[\"']" for a in ("aria-label", "aria-labelledby", "title", "id", "placeholder")))) > 0),
    Rule("a11y", "heading-order", "medium", 0.2, number("h1").equals(0) & (times("html", r"(?i)<h2\b") > 0)),
    Rule("a11y", "empty-link", "medium", 0.3, inner("html", ("a",), "^$") > 0),
    Rule("a11y", "button-no-aria", "low", 0.3, (elements("html", "button") >= 3) & elements("html", "button", yes=(r"(?i)\baria-label\s*=\s*[\"']",)).equals(0)),
    Rule("a11y", "no-zoom", "medium", 0.1, has("html", r"(?i)user-scalable\s*=\s*no|maximum-scale\s*=\s*1(?:\.0)?\b", ("user-scalable", "maximum-scale"))),
    Rule("a11y", "positive-tabindex", "low", 0.3, has("html", r"(?i)tabindex\s*=\s*[\"']?[1-9]", ("tabindex",))),
    Rule("legal", "tracker-no-cmp", "high", 0.6, any_of(*(has("html", t) for t in TRACKERS)) & ~true("consent"), risk=12000),
    Rule("legal", "no-privacy-link", "medium", 0.3, ~PRIVACY, plausible=True, risk=4000),
    Rule("legal", "no-legal-notice", "medium", 0.3, ~LEGAL, plausible=True, risk=3000),
    Rule("analytics", "no-analytics", "low", 0.3, ~any_of(GA4, GTM, OLD_UA, HINT) & ~true("consent") & ~has("html", "(?i)rgpd|gdpr"), plausible=True),
    Rule("analytics", "legacy-ua", "high", 0.5, OLD_UA & ~GA4),
    Rule("analytics", "double-tagging", "medium", 0.3, GA4 & GTM),
    Rule("analytics", "no-consent-mode", "medium", 0.4, (GA4 | GTM) & ~CONSENT_MODE),
    Rule("ux", "long-form", "medium", 0.4, number("most_fields") > 7),
    Rule("ux", "tiny-font", "low", 0.2, has("html", r"(?i)font-size\s*:\s*(?:[0-9]|1[0-1])px", ("font-size",))),
    Rule("ux", "nav-overload", "low", 0.3, times("header", r"(?i)<a\b") > 9),
    Rule("ux", "thin-page", "medium", 0.5, length("text") < 200),
    Rule("ux", "no-favicon", "info", 0.1, ~has("html", r"(?i)rel=[\"'](?:icon|shortcut icon|apple-touch-icon)[\"']", ("icon",))),
    Rule("cro", "no-cta", "high", 0.4, number("calls").equals(0), gain=4000),
    Rule("cro", "weak-value-prop", "medium", 0.4, number("h1_chars") < 8, gain=2500),
    Rule("cro", "no-social-proof", "low", 0.5, ~PROOF, gain=1500),
    Rule("cro", "cta-overload", "low", 0.3, number("calls") > 6, gain=800),
    Rule("content", "unresolved-i18n", "high", 0.3, has("text", RAW_KEY, (".title", ".label", ".description", ".cta", ".button", ".heading", ".subtitle"))),
    Rule("content", "stale-copyright", "low", 0.1, (number("copyright") > 0) & (number("copyright") < 2025)),
    Rule("content", "lang-mismatch", "medium", 0.4, has("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']fr[a-z-]*[\"']") & (times("text", ENGLISH) > 8) & times("text", ENGLISH).exceeds(times("text", FRENCH))),
)

AGENTS = tuple(dict.fromkeys(r.agent for r in RULES))


def _folding() -> tuple[str, str]:
    """Letters with accents, and marks by themselves, for translate(): what is left of each when its canonical decomposition loses its marks."""
    marks = [chr(c) for c in range(0x300, 0x370)]
    bare = {chr(c): "".join(x for x in unicodedata.normalize("NFD", chr(c)) if x not in marks) for c in range(0xC0, 0x2000)}
    kept = {c: b for c, b in bare.items() if len(b) == 1 and b != c}
    return "".join([*kept, *marks]), "".join(kept.values())


FOLDED = _folding()
COPYRIGHT = r"(?i)(?:©|copyright|\bcopy\b)[^0-9]{0,10}(20\d{2})"
FORM_FIELDS = r"(?i)<input\b|<select\b|<textarea\b"


#: Elements that several rules look at.
ONCE = ("img", "meta", "button")


def page_facts(pages: DataFrame) -> DataFrame:
    """page_id, url, html and all that the rules look at; a null page is empty."""
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", html.alias("html"))
    forms = F.split("html", r"(?i)<form(?![0-9A-Za-z_])")
    fields = F.transform(F.slice(forms, F.lit(2), F.size(forms)), lambda f: F.regexp_count(F.get(F.split(f, "(?i)</form>"), F.lit(0)), F.lit(java(FORM_FIELDS))))
    base = base.select(
        "*",
        *[c.alias(n) for n, c in facts("html").items()],
        visible_text(F.col("html")).alias("text"),
        F.get(F.split("html", "(?i)</head>"), F.lit(0)).alias("head"),
        F.get(F.split("html", "(?i)</header>"), F.lit(0)).alias("header"),
        F.lower("html").alias("low_html"),
        *[opening("html", n).alias(f"all_{n}") for n in ONCE],
        F.array_join(F.regexp_extract_all("html", F.lit(r"(?i)<label(?![0-9A-Za-z_])[^>]*>[\s\S]*?</label>"), F.lit(0)), "\n").alias("labels"),
        F.coalesce(F.array_max(fields), F.lit(0)).alias("most_fields"),
        F.length(F.regexp_replace(F.regexp_replace(F.regexp_extract("html", java(r"(?i)<h1\b[^>]*>([\s\S]*?)</h1>"), 1), "<[^>]+>", ""), r"^\s+|\s+$", "")).alias("h1_chars"),
    )
    base = base.select("*", F.lower("text").alias("low_text"), F.translate("low_html", *FOLDED).alias("folded"), has("html", CONSENT).column().alias("consent"), CALLS.column().alias("calls"))
    year = F.when(F.col("text").contains("©") | F.contains("low_text", F.lit("cop")), F.regexp_extract("text", java(COPYRIGHT), 1).try_cast("int"))
    return base.select("*", F.col("folded").alias("low_folded"), F.coalesce(year, F.lit(0)).alias("copyright"))


def column_name(rule: Rule) -> str:
    return rule.id.replace("-", "_")


def verdicts(pages: DataFrame, agent: str) -> DataFrame:
    """page_id and one boolean for each rule of an agent."""
    return page_facts(pages).select("page_id", *[r.when.column().alias(column_name(r)) for r in RULES if r.agent == agent])


def findings(pages: DataFrame, agents: tuple[str, ...] = AGENTS) -> DataFrame:
    """One row for each rule that a page breaks, from one scan: page_id, url, agent, rule, severity, effort, verdict, kind, emit_seq."""
    chosen = [(i, r) for i, r in enumerate(RULES) if r.agent in agents]
    rows = F.array(*[F.when(r.when.column(), F.struct(F.lit(r.agent).alias("agent"), F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.effort).alias("effort"), F.lit("plausible" if r.plausible else "confirmed").alias("verdict"), F.lit("gain" if r.gain else "risk").alias("kind"), F.lit(i).alias("emit_seq"))) for i, r in chosen])
    return page_facts(pages).select("page_id", "url", F.explode(F.array_compact(rows)).alias("f")).select("page_id", "url", "f.*")

