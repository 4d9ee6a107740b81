"""Hashes, names, colours, targets and entropy as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def djb2(text: Column) -> Column:
    """h = 5381, then h * 33 + code, modulo 2^32, over the characters."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: (h * 33 + c).bitwiseAND(4294967295))


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def finding_id(agent: Column, rule: Column, place: Column, line: Column) -> Column:
    """PREFIX-hash of a finding."""
    key = F.concat(rule, F.lit(":"), place, F.lit(":"), F.coalesce(line, F.lit(0)).cast("string"))
    return F.concat(F.upper(F.substring(agent, 1, 3)), F.lit("-"), base36(djb2(key)))


def slug(rule: Column) -> Column:
    """Lower case, runs of other characters than letters and digits made one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(rule, F.lit(""))), "[^a-z0-9]+", "-"), "^-|-$", "")


def place(file: Column, line: Column, url: Column, selector: Column) -> Column:
    """Where a finding stands: file:line, else url, else selector, else global; empty text counts as none."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(F.when(some(file).isNotNull(), F.concat(file, F.lit(":"), F.coalesce(line, F.lit(0)).cast("string"))), some(url), some(selector), F.lit("global"))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)

    def bits(c):
        p = F.size(F.filter(chars, lambda x: x == c)) / n
        return -p * F.log2(p)

    return F.when(n > 0, F.aggregate(F.transform(F.array_distinct(chars), bits), F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)


def channel(value: Column) -> Column:
    c = value / 255.0
    return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * channel(r) + 0.7152 * channel(g) + 0.0722 * channel(b)


def contrast(a: Column, b: Column) -> Column:
    """The ratio of two luminances, 1 to 21."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def flatten(front: Column, back: Column, alpha: Column) -> Column:
    return F.floor(front * alpha + back * (1 - alpha) + 0.5)


def hex_channel(colour: Column, i: int) -> Column:
    """Channel i of #rgb or #rrggbb, as a number; null for other text."""
    long = F.conv(F.substring(colour, 2 + 2 * i, 2), 16, 10)
    short = F.conv(F.concat(F.substring(colour, 2 + i, 1), F.substring(colour, 2 + i, 1)), 16, 10)
    return F.when(colour.rlike("^#[0-9A-Fa-f]{6}$"), long).when(colour.rlike("^#[0-9A-Fa-f]{3}$"), short).cast("int")


#: Hosts and addresses that must not be audited.
BLOCKED_HOST = r"(?i)^(localhost|.*\.localhost|.*\.local|.*\.internal|ip6-localhost)$"
PRIVATE_ADDRESS = r"^(10|127|0)\.\d{1,3}\.\d{1,3}\.\d{1,3}$|^169\.254\.\d{1,3}\.\d{1,3}$|^172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}$|^192\.168\.\d{1,3}\.\d{1,3}$|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.\d{1,3}\.\d{1,3}$"
PRIVATE_SIX = r"(?i)^\[?(::1?\]?$|fe80:|fc|fd)"


def target(raw: Column) -> tuple[Column, Column]:
    """(host, verdict) of an address somebody wants audited: ok, scheme, host or empty."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    full = F.when(text.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), text).otherwise(F.concat(F.lit("https://"), text))
    host = F.lower(F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    inside = host.rlike(BLOCKED_HOST) | host.rlike(PRIVATE_ADDRESS) | host.rlike(PRIVATE_SIX)
    return host, F.when((text == "") | (host == ""), "empty").when(~full.rlike("(?i)^https?://"), "scheme").when(inside, "host").otherwise("ok")


def clone_url(url: Column) -> Column:
    """The address a public repository is cloned from, ending in .git; null for all that isn't a plain https address."""
    return F.when(url.rlike(r"^https://[A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+\z"), F.concat(F.regexp_replace(url, r"\.git$", ""), F.lit(".git")))


def client(headers: Column) -> Column:
    """Who asks: the address the edge saw, else the first that was forwarded, else `unknown`; headers: a map."""
    told = lambda name: F.nullif(F.trim(F.get(F.split(F.coalesce(F.try_element_at(headers, F.lit(name)), F.lit("")), ","), F.lit(0))), F.lit(""))
    return F.coalesce(F.nullif(F.try_element_at(headers, F.lit("x-nf-client-connection-ip")), F.lit("")), told("x-forwarded-for"), F.lit("unknown"))


def origin_of(target: Column) -> Column:
    """Scheme, host and port of an address, https where it names no scheme; other text stays as it is."""
    full = F.when(target.rlike("^https?://"), target).otherwise(F.concat(F.lit("https://"), target))
    own = F.regexp_replace(F.lower(F.regexp_extract(full, r"^(https?://[^/?#\s]+)", 1)), "^(https?://)[^@]*@", "$1")
    return F.coalesce(F.nullif(own, F.lit("")), target)


def host_of(target: Column) -> Column:
    """Host and port of an address; other text stays as it is."""
    return F.regexp_replace(origin_of(target), "^https?://", "")
