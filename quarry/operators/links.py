"""The link graph of crawled pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.html import HREF
from quarry.functions.lineage import written
from quarry.plans.expr import java

# Fixed value: endings of files that aren't pages.
ASSET = r"(?i)\.(png|jpe?g|gif|webp|avif|svg|ico|css|js|mjs|json|xml|txt|pdf|zip|woff2?|ttf|eot|mp4|webm|mp3|map)(\?|$)"


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def undotted(url: Column) -> Column:
    """An address whose path has no `.` and `..` parts: each `..` takes the part before it away."""
    root, rest = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1), F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([\s\S]*)$", 1)
    path, tail = F.regexp_extract(rest, r"^([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*([\s\S]*)$", 1)
    parts = F.split(path, "/")
    start = F.array().cast("array<string>")
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    last = F.element_at(parts, -1)
    end = F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    clean = F.concat(root, F.lit("/"), F.array_join(kept, "/"), end, tail)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), clean).otherwise(url)


def resolve(href: Column, base: Column) -> Column:
    """An absolute address: full ones, those with a host, a path from the root, and paths beside the page, without dots."""
    return undotted(_joined(href, base))


def _joined(href: Column, base: Column) -> Column:
    root = origin(base)
    beside = F.concat(root, F.regexp_extract(F.regexp_extract(base, r"^[^:]+://[^/?#]*([^?#]*)", 1), "^(.*/)", 1))
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, "^([^:]+:)", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(F.startswith(href, F.lit("#")) | (href == ""), base)
        .when(F.startswith(href, F.lit("?")), F.concat(F.regexp_extract(base, "^([^?#]*)", 1), href))
        .otherwise(F.concat(F.when(beside == root, F.concat(root, F.lit("/"))).otherwise(beside), href))
    )


def normal(url: Column, own: Column) -> Column:
    """A link's address without fragment and closing slashes; null for other origins, schemes and files."""
    plain = F.regexp_replace(url, "#.*$", "")
    path = F.regexp_extract(plain, r"^[^:]+://[^/?#]*([^?]*)", 1)
    query = F.regexp_extract(plain, r"(\?.+)$", 1)
    tidy = F.regexp_replace(path, "/+$", "")
    out = F.concat(own, F.when(tidy == "", "/").otherwise(tidy), query)
    return F.when((origin(plain) == own) & own.rlike("(?i)^https?://") & ~path.rlike(ASSET), out)


def links(pages: DataFrame) -> DataFrame:
    """src, dst: the distinct links of each page to pages of its own origin."""
    found = pages.select("url", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(java(HREF)), F.lit(1))).alias("href"))
    return found.select(F.col("url").alias("src"), normal(resolve(F.col("href"), F.col("url")), origin(F.col("url"))).alias("dst")).where("dst is not null").distinct()


def broken(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Targets that no known page answers: dst, sources."""
    known = pages.select(normal(F.col("url"), origin(F.col("url"))).alias("dst")).distinct()
    return edges.join(known, "dst", "left_anti").groupBy("dst").agg(F.countDistinct("src").alias("sources"))


def homes(pages: DataFrame) -> DataFrame:
    """url: one page of each origin to start from, that of the shortest address, then the first."""
    known = normal_pages(pages)
    return known.groupBy(origin(F.col("url")).alias("own")).agg(F.min(F.struct(F.length("url"), "url")).alias("x")).select("x.url")


def normal_pages(pages: DataFrame) -> DataFrame:
    """url: the distinct addresses of the pages, as links name them."""
    return pages.select(normal(F.col("url"), origin(F.col("url"))).alias("url")).where("url is not null").distinct()


def crawl(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """url, depth: what links reach from the seeds, in at most `depth` steps if that is given; addresses that were seen go no further.

    edges: src, dst, both as `normal` makes them.  Each step's frontier is
    written, so a plan never holds the steps before it.
    """
    edges = written(edges.select("src", "dst").distinct())
    seen = frontier = written(seeds.select("url", F.lit(0).alias("depth")).distinct())
    step = 0
    while depth is None or step < depth:
        step += 1
        reached = frontier.join(edges, frontier["url"] == edges["src"]).select(F.col("dst").alias("url")).distinct()
        frontier = written(reached.join(seen, "url", "left_anti").select("url", F.lit(step).alias("depth")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def paths(pages: DataFrame, most: int = 100) -> DataFrame:
    """page_id, place, path: the distinct paths of a page's links to its own origin, the first `most` in the order of the page; pages: page_id, url, html."""
    found = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(java(HREF)), F.lit(1))).alias("pos", "href"))
    full = found.select("page_id", "pos", F.regexp_replace(resolve(F.col("href"), F.col("url")), "[?#].*$", "").alias("full"), origin(F.col("url")).alias("own")).where(origin(F.col("full")) == F.col("own"))
    one = full.select("page_id", "pos", F.coalesce(F.nullif(F.substr("full", F.length("own") + 1), F.lit("")), F.lit("/")).alias("path")).groupBy("page_id", "path").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("page_id").orderBy("pos")
    return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("page_id", "place", "path")


def duplicates(pages: DataFrame, value: str, most: int = 8) -> DataFrame:
    """Values that several pages share, lower-cased: n, the first page, its spelling, and the first pages' ids.

    The ids that are shown are ranked before they are gathered.
    """
    some = pages.where(F.col(value).isNotNull()).select("page_id", F.lower(value).alias("value"), F.col(value).alias("spelled"))
    order = Window.partitionBy("value").orderBy("page_id")
    shown = some.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).groupBy("value").agg(F.array_join(F.array_sort(F.collect_list("page_id")), ",").alias("pages"))
    counts = some.groupBy("value").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"), F.min_by("spelled", "page_id").alias("spelled")).where("n > 1")
    return counts.join(shown, "value")
