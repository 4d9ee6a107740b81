"""Readers: repositories, scanners' reports, answers of name servers, pages that were fetched."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What is read of a repository.
SKIPPED = r"/(node_modules|\.git|dist|build|\.next|out|coverage|vendor)/"
EXTENSIONS = ("js", "ts", "jsx", "tsx", "mjs", "cjs", "py", "rb", "php", "go", "java", "html", "vue", "svelte", "json", "yml", "yaml", "toml", "sql", "prisma", "sh", "env", "ini", "cfg")
LANGUAGE = {"js": "js", "mjs": "js", "cjs": "js", "jsx": "jsx", "ts": "ts", "tsx": "tsx", "py": "py", "php": "php", "html": "html", "env": "env"}
LARGEST = 1_000_000
DATABASES = r"(?i)prisma|pg(?![0-9A-Za-z_])|mysql|mongoose|mongodb|sequelize|typeorm|drizzle|knex|@supabase|sqlite"
MAILERS = r"(?i)nodemailer|@sendgrid|resend|postmark|mailgun|@aws-sdk/client-ses"
LOCALE = r"(?i)(?:^|/)(en|fr|de|es|it|nl|pt|locales?|i18n|lang|translations?)[/.]"
LARGEST_LOCALE = 500_000

SCANNER = "results array<struct<check_id:string,path:string,start:struct<line:int>,extra:struct<lines:string,message:string,severity:string,metadata:struct<cwe:array<string>,fix:string>>>>"
AXE = "violations array<struct<id:string,impact:string,help:string,tags:array<string>,nodes:array<struct<target:array<string>,failureSummary:string>>>>"


def repository(spark: SparkSession, root: str, largest: int = LARGEST) -> DataFrame:
    """file, ext, lang, text of the source files below a folder; big and binary files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= largest)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    langs = F.create_map(*[F.lit(x) for pair in LANGUAGE.items() for x in pair])
    kept = raw.where(~F.col("path").rlike(SKIPPED) & (ext.isin(*EXTENSIONS) | F.col("path").rlike(r"/\.env[^/]*$")))
    return kept.select(F.col("path").alias("file"), ext.alias("ext"), langs[ext].alias("lang"), F.decode("content", "UTF-8").alias("text")).where(~F.contains("text", F.char(F.lit(0))))


def committed_env(files: DataFrame) -> DataFrame:
    """Environment files in a repository that aren't examples."""
    return files.where(F.col("file").rlike(r"(^|/)\.env(\.[A-Za-z]+)?$") & ~F.col("file").rlike(r"\.(example|sample)$")).select("file")


def scanner_findings(report: DataFrame) -> DataFrame:
    """rule, severity, file, line, cwe, match of a structural scanner's report (column `results`)."""
    r = report.select(F.explode("results").alias("r"))
    severity = F.create_map(*[F.lit(x) for x in ("ERROR", "high", "WARNING", "medium", "INFO", "low")])
    return r.select(
        F.concat(F.lit("scanner:"), F.element_at(F.split("r.check_id", r"\."), -1)).alias("rule"),
        F.coalesce(severity[F.upper("r.extra.severity")], F.lit("medium")).alias("severity"),
        F.col("r.path").alias("file"),
        F.col("r.start.line").alias("line"),
        F.nullif(F.regexp_extract(F.coalesce(F.get("r.extra.metadata.cwe", F.lit(0)), F.lit("")), r"(CWE-\d+)", 1), F.lit("")).alias("cwe"),
        F.col("r.extra.lines").alias("match"),
    )


def axe_findings(report: DataFrame) -> DataFrame:
    """rule, severity, criterion, targets (first five) of an accessibility report (column `violations`)."""
    v = report.select(F.explode("violations").alias("v"))
    severity = F.create_map(*[F.lit(x) for x in ("critical", "high", "serious", "high", "moderate", "medium", "minor", "low")])
    return v.select(F.concat(F.lit("axe:"), F.col("v.id")).alias("rule"), F.coalesce(severity[F.col("v.impact")], F.lit("medium")).alias("severity"), F.array_join(F.filter("v.tags", lambda t: t.rlike("^wcag")), ",").alias("criterion"), F.array_join(F.flatten(F.transform(F.slice("v.nodes", 1, 5), lambda n: n["target"])), " ").alias("targets"))


def lighthouse_findings(audits: DataFrame) -> DataFrame:
    """rule, severity of measured page speed below 0.9; audits: id, score."""
    ids = {"largest-contentful-paint": "lcp", "cumulative-layout-shift": "cls", "total-blocking-time": "tbt", "speed-index": "speed-index"}
    names = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    return audits.where(F.col("id").isin(*ids) & (F.col("score") < 0.9)).select(F.concat(F.lit("lighthouse:"), names[F.col("id")]).alias("rule"), F.when(F.col("score") < 0.5, "high").otherwise("medium").alias("severity"))


def packages(files: DataFrame) -> DataFrame:
    """file, uses_database, sends_email by the names in package.json files; files: file, text."""
    deps = F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>")
    names = F.array_join(F.array_union(F.coalesce(F.map_keys(deps["dependencies"]), F.array().cast("array<string>")), F.coalesce(F.map_keys(deps["devDependencies"]), F.array().cast("array<string>"))), " ")
    return files.select("file", names.rlike(DATABASES).alias("uses_database"), names.rlike(MAILERS).alias("sends_email"))


def locale_keys(files: DataFrame, largest: int = LARGEST_LOCALE) -> DataFrame:
    """file, key of the JSON files that hold translations: the dotted path of each leaf, where lists are leaves.

    Files that aren't JSON objects have no keys; files: file, text.
    """
    kept = files.where(F.col("file").rlike(LOCALE) & F.col("file").rlike(r"\.json$") & (F.octet_length("text") <= largest)).select("file", "text")

    def leaves(text: str):
        try:
            whole = json.loads(text)
        except ValueError:
            return
        open_ = [("", whole)] if isinstance(whole, dict) else []
        while open_:
            path, value = open_.pop()
            if isinstance(value, dict):
                open_ += [(f"{path}.{k}" if path else k, v) for k, v in value.items()]
            else:
                yield path

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys = list(dict.fromkeys(leaves(batch.column(1)[i].as_py())))
                yield pa.RecordBatch.from_pydict({"file": pa.array([batch.column(0)[i].as_py()] * len(keys), pa.string()), "key": pa.array(keys, pa.string())})

    return kept.mapInArrow(read, "file string, key string")


AUDIT = "id string, target string, status string, score int, at timestamp, summary struct<weighted_score:int>, tenant string"


def audits(spark: SparkSession, path: str) -> DataFrame:
    """The audits that `save` wrote: one folder of JSON for each tenant; a folder that isn't there gives no rows."""
    return optional(spark, path, AUDIT)


def optional(spark: SparkSession, path: str, schema: str, format: str = "json") -> DataFrame:
    """A source that may be missing, such as an outside scanner's report: then an empty table of its schema."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(conf).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(format).load(path)


def browser_allowed(scopes: DataFrame, enabled: bool = True) -> DataFrame:
    """site, allowed: never if browsers are switched off, else as the site says, else only with a repository; scopes: site, browser_scan, repo."""
    return scopes.select("site", (F.lit(enabled) & F.coalesce("browser_scan", F.coalesce("repo", F.lit(False)))).alias("allowed"))
