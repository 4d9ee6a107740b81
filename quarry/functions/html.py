"""Facts of a page, from its HTML, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.plans.expr import java

TITLE = r"(?i)<title\b[^>]*>([\s\S]*?)</title>"
DESCRIPTION = (
    r"(?i)<meta\b[^>]*name\s*=\s*[\"']description[\"'][^>]*content\s*=\s*[\"']([^\"']*)[\"']",
    r"(?i)<meta\b[^>]*content\s*=\s*[\"']([^\"']*)[\"'][^>]*name\s*=\s*[\"']description[\"']",
)
CANONICAL = r"(?i)<link\b[^>]*rel\s*=\s*[\"']canonical[\"'][^>]*href\s*=\s*[\"']([^\"']*)[\"']"
NOINDEX = r"(?i)<meta\b[^>]*name\s*=\s*[\"']robots[\"'][^>]*noindex"
HREF = r"(?i)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']+)[\"']"


def first(source, pattern: str) -> Column:
    """The first group of the first match, without outer spaces; null if there is none or it is empty."""
    return F.nullif(F.regexp_replace(F.regexp_extract(source, java(pattern), 1), r"^\s+|\s+$", ""), F.lit(""))


def tag(html, name: str) -> Column:
    return first(html, rf"(?i)<{name}\b[^>]*>([\s\S]*?)</{name}>")


def tags(html, name: str) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(java(rf"(?i)<{name}\b[^>]*>([\s\S]*?)</{name}>")), F.lit(1)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def opening(html, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(java(rf"(?i)<{name}\b[^>]*>")), F.lit(0))


def attribute(opening_tag, name: str) -> Column:
    """The quoted value of an attribute, or null."""
    pattern = java(rf"(?i)\b{name}\s*=\s*[\"']([^\"']*)[\"']")
    return F.when(opening_tag.rlike(pattern), F.regexp_extract(opening_tag, pattern, 1))


def meta(html, key: str) -> Column:
    """The content of the first meta element that the key finds."""
    return attribute(F.get(F.filter(opening(html, "meta"), lambda m: m.rlike("(?i)" + key)), F.lit(0)), "content")


def without_tags(html) -> Column:
    for pattern in (r"(?i)<script[\s\S]*?</script>", r"(?i)<style[\s\S]*?</style>", "<[^>]+>"):
        html = F.regexp_replace(html, pattern, " ")
    return html


def visible_text(html) -> Column:
    """The text without scripts, styles, tags and entities, white space made single."""
    return F.trim(F.regexp_replace(F.regexp_replace(without_tags(html), "(?i)&[a-z#0-9]+;", " "), r"\s+", " "))


def facts(html) -> dict[str, Column]:
    html = F.col(html) if isinstance(html, str) else html
    return {
        "title": first(html, TITLE),
        "descr": F.coalesce(*[first(html, p) for p in DESCRIPTION]),
        "h1": F.regexp_count(html, F.lit(java(r"(?i)<h1\b"))),
        "canonical": first(html, CANONICAL),
        "noindex": html.rlike(java(NOINDEX)),
        "words": F.regexp_count(without_tags(html), F.lit(r"\S+")),
    }
