"""Rules over the packages that a repository names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: files that pin the versions of packages.
LOCKS = r"/(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|bun\.lockb?)$"


def version(text: Column) -> Column:
    """Major, minor and patch number of the first version in a text, missing ones 0; null without one."""
    part = lambda i: F.coalesce(F.regexp_extract(text, r"(\d+)(?:\.(\d+))?(?:\.(\d+))?", i).try_cast("int"), F.lit(0))
    return F.when(text.rlike(r"\d"), F.array(*[part(i) for i in (1, 2, 3)]))


def packages(files: DataFrame) -> DataFrame:
    """file, name, wanted of all dependencies in package.json files; broken JSON names none; files: file, text."""
    known = F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>")
    none = F.create_map().cast("map<string,string>")
    every = F.concat(*[F.map_entries(F.coalesce(known[k], none)) for k in ("dependencies", "devDependencies")])
    named = files.where(F.concat(F.lit("/"), "file").rlike(r"/package\.json$"))
    return named.select("file", F.explode(every).alias("d")).select("file", F.col("d.key").alias("name"), F.col("d.value").alias("wanted")).distinct()


def unlocked(files: DataFrame) -> DataFrame:
    """folder, rule of folders with a package.json and no lock file; files: file."""
    path = F.concat(F.lit("/"), F.col("file"))
    per = files.select(F.regexp_extract(path, "^(.*)/", 1).alias("folder"), path.rlike(r"/package\.json$").alias("names"), path.rlike(LOCKS).alias("pins"))
    return per.groupBy("folder").agg(F.bool_or("names").alias("names"), F.bool_or("pins").alias("pins")).where("names and not pins").select("folder", F.lit("missing-lockfile").alias("rule"))


def vulnerable(packages: DataFrame, advisories: DataFrame) -> DataFrame:
    """file, name, wanted, advisory, severity, fixed of packages whose version an advisory covers.

    advisories: advisory, name, introduced, fixed, severity; a null
    `introduced` covers all before `fixed`, a null `fixed` all after.
    """
    own = version(F.col("wanted"))
    covers = (own >= F.coalesce(version(F.col("introduced")), F.array(*[F.lit(0)] * 3))) & (F.col("fixed").isNull() | (own < version(F.col("fixed"))))
    return packages.join(advisories, "name").where(covers).select("file", "name", "wanted", "advisory", "severity", "fixed")
