"""Reading whole sites over the network: crawls, link checks, style sheets and mail records."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.html import attribute, opening
from quarry.functions.lineage import written
from quarry.operators.links import links, normal, origin, resolve
from quarry.sources.fetch import names, responses

# How far a crawl goes, how many links are checked, style sheets of a page, and selectors of mail keys.
PAGES, SECONDS, CHECKED, SHEETS = 12, 16.0, 25, 6
SELECTORS = ("default", "google", "selector1", "selector2", "k1", "dkim", "mail")


def first_of(urls: DataFrame, most) -> DataFrame:
    """own, url: the first addresses of each origin; `most` is a number or a column of the rows."""
    order = Window.partitionBy("own").orderBy("depth", "url")
    return urls.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def crawl(seeds: DataFrame, max_pages: int = PAGES, seconds: float = SECONDS, **options) -> DataFrame:
    """url, depth, status, html, error of what a breadth-first crawl of each seed's origin reads; seeds: url.

    Each origin has at most `max_pages` pages, in the order of their depth and
    address.  A step asks what is left of the frontier and writes the answers;
    no step begins after `seconds`.  Options are those of fetch.responses.
    """
    began, step = time.monotonic(), 0
    frontier = seeds.select(normal(F.col("url"), origin(F.col("url"))).alias("url")).where("url is not null").distinct().select("url", origin(F.col("url")).alias("own"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("read"))
    seen = got = None
    while step == 0 or time.monotonic() - began < seconds:
        asked = written(first_of(frontier, F.lit(max_pages) - F.col("read")).select("own", "url", "depth"))
        if asked.isEmpty():
            break
        answers = written(asked.join(responses(asked, **options).select("url", "status", F.col("body").alias("html"), "error"), "url"))
        got = answers if got is None else got.unionByName(answers)
        here = frontier.select("url")
        seen = written(here if seen is None else seen.unionByName(here).distinct())
        step += 1
        pages = answers.where("error is null").select("url", "html")
        found = links(pages).select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti").select("url", origin(F.col("url")).alias("own"), F.lit(step).alias("depth"))
        frontier = found.join(got.groupBy("own").agg(F.count("*").alias("read")), "own")
    return got.select("url", "depth", "status", "html", "error")


def check_links(urls: DataFrame, most: int = CHECKED, **options) -> DataFrame:
    """url, status (0 for an error), error of the first addresses of each origin; urls: url."""
    asked = first_of(urls.select("url").distinct().select("url", origin(F.col("url")).alias("own"), F.lit(0).alias("depth")), most)
    return responses(asked.select("url"), **options).select("url", F.coalesce("status", F.lit(0)).alias("status"), "error")


def broken_links(pages: DataFrame, most: int = 20, **options) -> DataFrame:
    """url, status: visited pages that failed, and links that no page answers and that fail when they are asked; pages: url, status, html, error."""
    failed = (F.col("status") >= 400) | F.col("error").isNotNull()
    visited = pages.where(failed).select("url", F.coalesce("status", F.lit(0)).alias("status"))
    known = pages.select(normal(F.col("url"), origin(F.col("url"))).alias("url"))
    unknown = links(pages.where(~failed).select("url", "html")).select(F.col("dst").alias("url")).distinct().join(known, "url", "left_anti")
    told = check_links(unknown, most, **options).where("status >= 400 or status = 0").select("url", "status")
    return visited.unionByName(told).distinct()


def style_sheets(pages: DataFrame, most: int = SHEETS, **options) -> DataFrame:
    """url, css of the first linked sheets of each page that lie on its own origin, each asked once; pages: url, html."""
    hrefs = F.transform(F.filter(opening(F.coalesce("html", F.lit("")), "link"), lambda x: x.rlike(r"(?i)rel\s*=\s*[\"']stylesheet[\"']")), lambda x: attribute(x, "href"))
    wanted = pages.select("url", F.explode(F.slice(F.filter(hrefs, lambda h: h.isNotNull()), 1, most)).alias("href"))
    sheets = wanted.select(origin(F.col("url")).alias("own"), resolve(F.col("href"), F.col("url")).alias("url")).where(origin(F.col("url")) == F.col("own")).select("url").distinct()
    return responses(sheets, **options).where("error is null and body <> ''").select("url", F.col("body").alias("css"))


def mail_questions(domains: DataFrame) -> DataFrame:
    """domain, kind, name, type: what is asked about each domain's mail; domains: domain, whose `www.` goes."""
    asked = [("mx", "", "MX"), ("txt", "", "TXT"), ("dmarc", "_dmarc.", "TXT"), *[("dkim", f"{s}._domainkey.", "TXT") for s in SELECTORS]]
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(head), F.col("domain")).alias("name"), F.lit(type_).alias("type")) for kind, head, type_ in asked])
    return domains.select(F.regexp_replace("domain", r"^www\.", "").alias("domain")).distinct().select("domain", F.explode(rows).alias("q")).select("domain", "q.*")


def mail_records(domains: DataFrame, **options) -> DataFrame:
    """domain, kind, ok, answers, as response_rules.mail_findings reads them."""
    asked = written(mail_questions(domains))
    return asked.join(names(asked, **options), ["name", "type"]).select("domain", "kind", "ok", "answers")
