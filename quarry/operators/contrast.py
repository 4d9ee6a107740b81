"""Contrast of text and ground, from HTML and style sheets, without a browser.

A page is read once with a stack of open elements.  Each element takes over
what its parent resolved and changes what its own cascade sets, so no ancestor
is visited twice.  Colours are mixed and texts of equal colours counted there;
luminance and ratio are native columns, and one exchange ranks each page's pairs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import css
from quarry.functions.html import attribute, opening
from quarry.functions.text import contrast, luminance
from quarry.operators.links import origin, resolve

# Elements without content, elements whose text isn't judged, and the limits of readable text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head title meta noscript svg path code pre".split())
LARGE, LARGE_BOLD, BOLD = 24, 18.66, 700
LEAST, LEAST_LARGE, HIDDEN = 4.5, 3.0, 1.25
SOLID = 0.5
LINKED, REPORTED = 6, 8

TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9-]*)([^>]*)>")
REMARK = re.compile(r"<!--.*?-->", re.S)
STYLE = re.compile(r"<style\b[^>]*>(.*?)</style>", re.S | re.I)
CLOSER = {t: re.compile(f"</{t}>", re.I) for t in ("script", "style")}
GIVEN = re.compile(r"""(?:^|[\s"'])(id|class|style)\s*=\s*(?:"([^"]*)"|'([^']*)')""", re.I)

COLOURS = "page_id long, fg array<int>, bg array<int>, large boolean, n long, first int, example string, sure boolean"
ARROW = pa.schema([("page_id", pa.int64()), ("fg", pa.list_(pa.int32())), ("bg", pa.list_(pa.int32())), ("large", pa.bool_()), ("n", pa.int64()), ("first", pa.int32()), ("example", pa.string()), ("sure", pa.bool_())])


@dataclass
class Box:
    tag: str
    label: str = ""
    fg: tuple | None = (0, 0, 0, 1.0)
    source: str = "default"
    bg: tuple | None = None
    size: float = 16
    weight: int = 400
    text: list = field(default_factory=list)


def ground(sets: dict) -> tuple | None:
    """The background that an element itself sets."""
    found = css.colour(sets.get("background-color"))
    return found or next(filter(None, map(css.colour, (sets.get("background") or "").split())), None)


def inside(parent: Box, tag: str, label: str, sets: dict) -> Box:
    """An element with its parent's looks and its own settings."""
    box = replace(parent, tag=tag, label=label, text=[], source="default" if parent.source == "default" else "inherited")
    if sets.get("color"):
        box.fg, box.source = css.colour(sets["color"]), "self"
    own = ground(sets)
    if own and own[3] >= SOLID:
        box.bg = own
    if sets.get("font-size"):
        pixels = re.search(r"([\d.]+)px", sets["font-size"])
        box.size = float(pixels[1]) if pixels and re.fullmatch(r"\d+\.?\d*|\.\d+", pixels[1]) else 16
    if sets.get("font-weight"):
        number = re.match(r"\d+", sets["font-weight"])
        box.weight = BOLD if "bold" in sets["font-weight"] else int(number[0]) if number else 400
    return box


def boxes(html: str, sheets: list[str]) -> tuple[list[Box], tuple | None]:
    """All elements in the order they open, and the ground that the page itself sets.

    End tags without a start are passed over; an end tag closes what is open within its element.
    """
    cascade, html = css.Cascade(sheets), REMARK.sub("", html)
    out, stack, opened, unclosed = [], [Box("")], Counter(), set()
    body = page = None
    at, end = 0, html.rfind(">") + 1
    while found := TAG.search(html, at, end):
        stack[-1].text.append(html[at : found.start()])
        at = found.end()
        closes, tag, rest = found[1], found[2].lower(), found[3]
        if closes:
            while opened[tag]:
                gone = stack.pop().tag
                opened[gone] -= 1
                if gone == tag:
                    break
            continue
        if tag in CLOSER:
            closer = None if tag in unclosed else CLOSER[tag].search(html, at, end)
            at = closer.end() if closer else at
            if not closer:
                unclosed.add(tag)
            continue
        given = {}
        for m in GIVEN.finditer(rest):
            given.setdefault(m[1].lower(), m[2] if m[2] is not None else m[3])
        classes = given.get("class", "").lower().split()
        sets = cascade.of(tag, given.get("id", "").lower() or None, frozenset(classes)) | css.declarations(given.get("style"))
        if tag == "body" and not opened["body"]:
            body = ground(sets)
        if tag == "html" and len(stack) == 1 and page is None:
            page = ground(sets) or ()
        if tag not in VOID and not rest.endswith("/"):
            stack.append(inside(stack[-1], tag, ".".join([tag, *classes[:2]]), sets))
            opened[tag] += 1
            out.append(stack[-1])
    return out, next((c for c in (body, page) if c and c[3] >= SOLID), None)


def mixed(front: tuple, back: tuple) -> tuple[int, int, int]:
    """A colour over an opaque one."""
    alpha = min(1.0, front[3])
    return tuple(math.floor(f * alpha + b * (1 - alpha) + 0.5) for f, b in zip(front[:3], back))


def counted(html: str, sheets: list[str]):
    """Rows of COLOURS without the id: each pair of colours once, with its number of texts and the first of them."""
    every, base = boxes(html, sheets)
    paper, held = mixed(base, (255, 255, 255)) if base else (255, 255, 255), {}
    for i, box in enumerate(every):
        text = " ".join(" ".join(box.text).split())
        if box.fg is None or box.tag in SILENT or len(text) < 3 or not re.search("[A-Za-z0-9]", text):
            continue
        painted = bool(box.bg or base)
        if not painted and box.source == "default":
            continue
        back = mixed(box.bg, paper) if box.bg else paper
        large = box.size >= LARGE or (box.size >= LARGE_BOLD and box.weight >= BOLD)
        held.setdefault((mixed(box.fg, back), back, large), [0, i, f"{box.label}: {text[:40]}", painted and box.source != "inherited"])[0] += 1
    for (fg, bg, large), (n, first, example, sure) in held.items():
        yield list(fg), list(bg), large, n, first, example, sure


SMALL, COPIES = 4_000_000, 64


def _copied(wanted: DataFrame, sheets: DataFrame) -> DataFrame:
    """Each page's sheets with their text; sheets of SMALL bytes in all are broadcast, others dealt in COPIES, as one sheet may serve most pages."""
    if (sheets.agg(F.sum(F.octet_length("css"))).first()[0] or 0) <= SMALL:
        return wanted.join(F.broadcast(sheets), "sheet")
    copies = sheets.select("*", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"))
    return wanted.withColumn("copy", F.pmod(F.xxhash64("page_id"), F.lit(COPIES)).cast("int")).join(copies, ["sheet", "copy"])


def with_sheets(pages: DataFrame, sheets: DataFrame | None) -> DataFrame:
    """page_id, html, linked: the first linked style sheets of the page's own origin; sheets: url, css."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    if sheets is None:
        return base.select("page_id", "html", F.array().cast("array<string>").alias("linked"))
    hrefs = F.transform(F.filter(opening(F.col("html"), "link"), lambda x: x.rlike(r"(?i)rel\s*=\s*[\"']stylesheet[\"']")), lambda x: attribute(x, "href"))
    wanted = base.select("page_id", "url", F.posexplode(F.slice(F.filter(hrefs, lambda h: h.isNotNull()), 1, LINKED)).alias("place", "href"))
    wanted = wanted.select("page_id", "place", origin(F.col("url")).alias("own"), resolve(F.col("href"), F.col("url")).alias("sheet")).where(origin(F.col("sheet")) == F.col("own"))
    got = _copied(wanted, sheets.select(F.col("url").alias("sheet"), "css")).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "css"))), lambda x: x["css"]).alias("linked"))
    return base.join(got, "page_id", "left").select("page_id", "html", "linked")


def weak_pairs(pages: DataFrame, sheets: DataFrame | None = None, most: int = REPORTED) -> DataFrame:
    """The `most` least readable pairs of colours of each page.

    page_id, place, fg, bg, large, ratio, least, n, example, severity, verdict;
    pages: page_id (one row each), url, html.  A null page has none.  Pairs of a ratio under
    1.25 pass for hidden text; texts whose colours nobody sets aren't judged.
    """

    def read(batches):
        for batch in batches:
            ids, html, linked = batch.columns
            rows = [(ids[i].as_py(), *row) for i in range(batch.num_rows) for text in [html[i].as_py()] for row in counted(text, [*STYLE.findall(text), *(linked[i].as_py() or ())])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(ARROW), ARROW.types)], schema=ARROW)

    found = with_sheets(pages, sheets).mapInArrow(read, COLOURS)
    light = lambda c: luminance(*[F.get(c, F.lit(i)) for i in range(3)])
    shown = lambda c: F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(F.get(c, F.lit(i)))), 2, "0") for i in range(3)]).alias(c)
    order = Window.partitionBy("page_id").orderBy(F.round("ratio", 2), "first", "fg", "bg")
    weak = found.select("*", contrast(light("fg"), light("bg")).alias("ratio"), F.when(F.col("large"), LEAST_LARGE).otherwise(LEAST).alias("least"))
    weak = weak.where((F.col("ratio") < F.col("least")) & (F.col("ratio") >= HIDDEN)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return weak.select("page_id", "place", shown("fg"), shown("bg"), "large", F.round("ratio", 2).alias("ratio"), "least", "n", "example", F.when(F.col("sure"), "high").otherwise("medium").alias("severity"), F.when(F.col("sure"), "confirmed").otherwise("plausible").alias("verdict"))
