"""Predicates as Spark columns.

A predicate names the text it looks at (`html`, `text`, ...).  Patterns are
written with ASCII word boundaries.  Where a pattern ignores case and is, in
whole or in part, a choice of plain strings, these are looked for in the
lower-cased text, which a frame of facts has once as `low_<name>`; the pattern
engine sees only what is left.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "0-9A-Za-z_"
AFTER, BEFORE = f"(?<![{WORD}])", f"(?![{WORD}])"
#: A word boundary between ASCII word characters and all others, in Java's dialect.
EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
LETTER = re.compile("[0-9A-Za-z_]")
WORD_CLASS = re.compile(r"\[(?:0-9|A-Z|a-z|A-Za-z|_|[A-Za-z0-9])+\]")


def choices(pattern: str) -> list[str]:
    """The alternatives of a pattern, outside groups and classes."""
    out, depth, inside, i, start = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def _group_end(pattern: str) -> int:
    """Where the group that a pattern starts with ends."""
    for i in range(1, len(pattern) + 1):
        if pattern[i - 1] == ")" and len(choices(pattern[:i])) == 1 and pattern[:i].count("(") - pattern[:i].count("\\(") == pattern[:i].count(")") - pattern[:i].count("\\)"):
            return i
    return len(pattern)


def begins_word(rest: str) -> bool:
    """Whether all that a pattern matches surely begins with a word character."""
    if rest.startswith("(?") and not rest.startswith("(?:"):  # flags or a look-around
        return False
    if rest.startswith("("):
        body = rest[1 : _group_end(rest) - 1]
        return not rest[_group_end(rest) : _group_end(rest) + 1] in ("*", "?") and all(begins_word(a) for a in choices(body.removeprefix("?:")))
    one = WORD_CLASS.match(rest)
    if one:
        return rest[one.end() : one.end() + 1] not in ("*", "?")
    return bool(LETTER.match(rest)) and rest[1:2] not in ("*", "?")


def ends_word(head: str) -> bool:
    """Whether all that a pattern matches surely ends with a word character."""
    if re.search(r"(?<!\\)[0-9A-Za-z_]$", head):
        return True
    if re.search(WORD_CLASS.pattern + r"(?:\{[1-9]\d*(?:,\d*)?\}|\+)?$", head):
        return True
    if head.endswith(")") and not head.endswith("\\)"):
        for i in range(len(head) - 1, -1, -1):
            if head[i] == "(" and head[i - 1 : i] != "\\" and i + _group_end(head[i:]) == len(head):
                return not re.match(r"\(\?[^:]", head[i:]) and all(ends_word(a) for a in choices(head[i + 1 : -1].removeprefix("?:")))
    return False


def java(pattern: str) -> str:
    """The pattern with ASCII word boundaries, of one side where the other is a word character anyway."""
    parts = re.split(r"(?<!\\)\\b", pattern)
    out = parts[0]
    for i, part in enumerate(parts[1:], 1):
        out += (AFTER if begins_word(part) else BEFORE if ends_word(parts[i - 1]) else EDGE) + part
    return out


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def plain(choice: str) -> str | None:
    """The string that an alternative stands for, lower-cased, or None if it is more than a string."""
    bare = re.sub(r"\\([^0-9A-Za-z])", lambda m: chr(0xE000 + ord(m[1])), choice)
    if re.search(r"[\\.*+?()\[\]{}|^$]", bare):
        return None
    return "".join(chr(ord(c) - 0xE000) if ord(c) >= 0xE000 else c for c in bare).lower()


@dataclass(frozen=True)
class Term:
    """A value: `column` makes it over columns of the names it looks at."""

    column: Callable[[], Column]

    def __and__(self, other: Term) -> Term:
        return Term(lambda: self.column() & other.column())

    def __or__(self, other: Term) -> Term:
        return Term(lambda: self.column() | other.column())

    def __invert__(self) -> Term:
        return Term(lambda: ~self.column())

    def __gt__(self, n) -> Term:
        return Term(lambda: self.column() > n)

    def __ge__(self, n) -> Term:
        return Term(lambda: self.column() >= n)

    def __lt__(self, n) -> Term:
        return Term(lambda: self.column() < n)

    def exceeds(self, other: Term) -> Term:
        return Term(lambda: self.column() > other.column())

    def equals(self, n) -> Term:
        return Term(lambda: self.column() == n)


def holds(low: str, strings) -> Column:
    """Whether a lower-cased text holds any of some strings."""
    out = F.lit(False)
    for s in strings:
        out = out | F.contains(low, F.lit(s))
    return out


def has(source: str, pattern: str, needs: tuple[str, ...] = ()) -> Term:
    """Whether a text has a match; `needs`, if given, are lower-case strings of which every match holds one."""

    def column() -> Column:
        low = f"low_{source}"
        if not pattern.startswith("(?i)"):
            return F.col(source).rlike(java(pattern))
        strings, rest = [], []
        for c in choices(pattern[4:]):
            (rest if plain(c) is None else strings).append(c if plain(c) is None else plain(c))
        out = holds(low, strings)
        if rest:
            found = F.col(source).rlike(java("(?i)" + "|".join(rest)))
            out = out | (holds(low, needs) & found if needs else found)
        return out

    return Term(column)


def times(source: str, pattern: str) -> Term:
    return Term(lambda: F.regexp_count(source, F.lit(java(pattern))))


def length(source: str) -> Term:
    return Term(lambda: F.length(source))


def octets(source: str) -> Term:
    return Term(lambda: F.octet_length(source))


#: Elements that a frame of facts has as a column `all_<name>`.
SHARED = {("html", "img"), ("html", "meta"), ("html", "button")}


def elements(source: str, name: str, yes: tuple[str, ...] = (), no: tuple[str, ...] = (), missing: tuple[str, ...] = (), outside: str = "") -> Term:
    """How many opening tags match all of `yes` and none of `no`, lack any attribute of `missing`, and aren't in the text of the column `outside`."""
    tag = rf"(?i)<{name}\b[^>]*>"
    attribute = lambda a: rf"(?i)\b{a}\s*=\s*[\"'][^\"']*[\"']"

    def column() -> Column:
        def fits(x):
            out = F.lit(True)
            for p in yes:
                out = out & x.rlike(java(p))
            for p in no:
                out = out & ~x.rlike(java(p))
            if missing:
                lacks = F.lit(False)
                for a in missing:
                    lacks = lacks | ~x.rlike(java(attribute(a)))
                out = out & lacks
            return out & ~F.contains(F.col(outside), x) if outside else out

        tags = F.col(f"all_{name}") if (source, name) in SHARED else F.regexp_extract_all(source, F.lit(java(tag)), F.lit(0))
        return F.size(F.filter(tags, fits))

    return Term(column)


def inner(source: str, names: tuple[str, ...], pattern: str, strip: str = "") -> Term:
    """How many elements of these names have inner text, without tags and outer spaces, that the pattern finds."""
    bodies = [rf"(?i)<{n}\b[^>]*>([\s\S]*?)</{n}>" for n in names]

    def column() -> Column:
        every = F.concat(*[F.regexp_extract_all(source, F.lit(java(b)), F.lit(1)) for b in bodies])
        return F.size(F.filter(every, lambda x: F.regexp_replace(F.regexp_replace(x, "<[^>]+>", strip), r"^\s+|\s+$", "").rlike(java(pattern))))

    return Term(column)
