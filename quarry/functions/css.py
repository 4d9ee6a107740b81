"""Colours, style sheets and the cascade of simple selectors."""

from __future__ import annotations

import math
import re
from collections import defaultdict

# The colour names that are known.
NAMED = {
    "black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "green": (0, 128, 0), "blue": (0, 0, 255),
    "gray": (128, 128, 128), "grey": (128, 128, 128), "silver": (192, 192, 192),
    "lightgray": (211, 211, 211), "lightgrey": (211, 211, 211), "darkgray": (169, 169, 169), "darkgrey": (169, 169, 169),
    "dimgray": (105, 105, 105), "dimgrey": (105, 105, 105), "gainsboro": (220, 220, 220), "whitesmoke": (245, 245, 245),
    "maroon": (128, 0, 0), "navy": (0, 0, 128), "teal": (0, 128, 128), "olive": (128, 128, 0), "purple": (128, 0, 128),
    "orange": (255, 165, 0), "yellow": (255, 255, 0), "lime": (0, 255, 0), "aqua": (0, 255, 255), "cyan": (0, 255, 255),
    "fuchsia": (255, 0, 255), "magenta": (255, 0, 255), "slategray": (112, 128, 144), "slategrey": (112, 128, 144),
    "lightslategray": (119, 136, 153), "darkslategray": (47, 79, 79), "indigo": (75, 0, 130), "coral": (255, 127, 80), "tomato": (255, 99, 71),
}
# The properties that decide a contrast.
PROPERTIES = ("color", "background-color", "background", "font-size", "font-weight")

HEX = re.compile(r"#(?:[0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})")
CHANNELS = re.compile(r"rgba?\(([^)]+)\)")
NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)")
COMMENT = re.compile(r"/\*.*?\*/", re.S)
PSEUDO = re.compile(r"::?[a-z-]+(?:\([^)]*\))?", re.I)
SIMPLE = re.compile(r"(?P<tag>[a-z][a-z0-9-]*)?(?P<rest>(?:[.#][a-z0-9_-]+)*)", re.I)


def colour(text: str | None) -> tuple[int, int, int, float] | None:
    """Red, green, blue and alpha of a name, #rgb, #rgba, #rrggbb, #rrggbbaa, rgb() or rgba().

    None for all else: hsl(), var(), gradients, key words.  Channels are kept within 0 and 255.
    """
    s = (text or "").strip().lower()
    if s in NAMED:
        return (*NAMED[s], 1.0)
    if HEX.fullmatch(s):
        r, g, b, *a = bytes.fromhex(s[1:] if len(s) > 5 else "".join(c + c for c in s[1:]))
        return r, g, b, a[0] / 255 if a else 1.0
    call = CHANNELS.fullmatch(s)
    parts = re.split(r"[,\s/]+", call[1].strip()) if call else []
    values = [NUMBER.match(p) for p in parts[:4]]
    if len(values) < 3 or not all(values):
        return None
    size = lambda i, whole: float(values[i][0]) * (whole / 100 if "%" in parts[i] else 1)
    rgb = [min(255, max(0, math.floor(size(i, 255) + 0.5) if "%" in parts[i] else int(size(i, 255)))) for i in range(3)]
    return (*rgb, size(3, 1) if len(values) == 4 else 1.0)


def declarations(block: str | None) -> dict[str, str]:
    """The wanted properties that a block or a style attribute sets; the last of a property counts."""
    pairs = (d.partition(":") for d in (block or "").split(";"))
    return {name.strip().lower(): value.strip() for name, colon, value in pairs if colon and name.strip().lower() in PROPERTIES}


def selector(text: str):
    """(tag, id, classes, specificity) of a simple selector without its pseudo-classes; None for others."""
    found = SIMPLE.fullmatch(PSEUDO.sub("", text).strip())
    if not found or not found[0]:
        return None
    names = re.findall(r"[.#][^.#]+", found["rest"].lower())
    classes = frozenset(n[1:] for n in names if n[0] == ".")
    ids = [n[1:] for n in names if n[0] == "#"]
    tag = found["tag"].lower() if found["tag"] else None
    return tag, ids[0] if ids else None, classes, 100 * bool(ids) + 10 * sum(n[0] == "." for n in names) + bool(tag)


def blocks(css: str):
    """(selectors, body) of each innermost block, in order; blocks within @media and the like count as any other."""
    css, begin, head = COMMENT.sub("", css), 0, None
    for brace in re.finditer("[{}]", css):
        between = css[begin : brace.start()]
        if brace[0] == "{":
            head = between.rpartition(";")[2].strip()
        elif head is not None:
            yield head, between
            head = None
        begin = brace.end()


class Cascade:
    """What a page's style sheets set on an element: of the rules that fit, the most specific, then the last."""

    def __init__(self, sheets):
        self.rules, self.memo = defaultdict(list), {}
        number = 0
        for head, body in (block for sheet in sheets for block in blocks(sheet or "")):
            sets = declarations(body)
            for one in map(selector, head.split(",")) if sets else ():
                if one:
                    tag, name, classes, weight = one
                    key = ("#", name) if name else (".", min(classes)) if classes else ("", tag)
                    self.rules[key].append((weight, number, tag, classes, sets))
                    number += 1

    def of(self, tag: str, name: str | None, classes: frozenset) -> dict[str, str]:
        element = tag, name, classes
        if element not in self.memo:
            near = [r for key in (("", tag), ("#", name), *((".", c) for c in classes)) for r in self.rules.get(key, ())]
            fits = [r for r in near if r[2] in (None, tag) and r[3] <= classes]
            merged = {}
            for rule in sorted(fits, key=lambda r: r[:2]):
                merged.update(rule[4])
            self.memo[element] = merged
        return self.memo[element]
