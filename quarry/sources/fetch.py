"""Readers of the network: pages, name servers and certificates.

Each reader maps a table of what is wanted to what was answered, in as many
tasks as the table has partitions.  A request that fails gives a row with its
error, never an exception; a lost task asks again.
"""

from __future__ import annotations

import json
import re
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import target

# Kinds of content that are text, resolvers in the order they are asked, answers that prove something.
TEXT = re.compile(r"text/|json|xml|javascript", re.I)
RESOLVERS = ("https://cloudflare-dns.com/dns-query", "https://dns.google/resolve")
PROVES = (0, 3)

ANSWERS = "url string, final_url string, status int, headers map<string,string>, set_cookie array<string>, body string, ttfb_ms long, error string"


def _rows(columns: list[str], ask, threads: int, schema: pa.Schema):
    def run(batches):
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                for first in range(0, batch.num_rows, threads):
                    part = batch.slice(first, threads)
                    wanted = list(zip(*[part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]))
                    yield pa.RecordBatch.from_pylist(list(pool.map(lambda w: ask(*w), wanted)), schema=schema)

    return run


def _open(url: str, timeout: float, accept: str | None = None, most: int | None = None):
    """(final address, status, header pairs, body, milliseconds to the first byte); errors of HTTP are answers."""
    import time
    import urllib.error
    import urllib.request

    request = urllib.request.Request(url, headers={"user-agent": "audit-reader"} | ({"accept": accept} if accept else {}))
    began = time.monotonic()
    try:
        answer = urllib.request.urlopen(request, timeout=timeout)  # noqa: S310  schemes are checked before
    except urllib.error.HTTPError as e:
        answer = e
    with answer:
        first = int(1000 * (time.monotonic() - began))
        kind = answer.headers.get("content-type", "")
        body = answer.read(most).decode(answer.headers.get_content_charset() or "utf-8", "replace") if not kind or TEXT.search(kind) else ""
        return answer.url, answer.status, answer.headers.items(), body, first


def responses(urls: DataFrame, timeout: float = 9, threads: int = 8, guard: bool = True) -> DataFrame:
    """url, final_url, status, headers, set_cookie, body, ttfb_ms, error of each distinct url.

    Only text is read.  With `guard`, addresses of inner networks are not
    asked; their error is `blocked`.  A null url has the error `empty`.
    """
    _, verdict = target(F.col("url"))
    wanted = urls.select("url").distinct().select("url", (F.when(verdict == "ok", None).otherwise(verdict) if guard else F.lit(None).cast("string")).alias("bad"))

    def ask(url, bad):
        row = {"url": url}
        if bad or not url or not re.match("https?://", url, re.I):
            return row | {"error": "blocked" if bad == "host" else bad or "scheme"}
        try:
            final, status, pairs, body, first = _open(url, timeout)
        except Exception as e:  # noqa: BLE001  whatever a server does is an answer
            return row | {"error": f"{type(e).__name__}: {e}"[:200]}
        headers = {}
        for name, value in pairs:
            headers[name.lower()] = value
        return row | {"final_url": final, "status": status, "headers": list(headers.items()), "set_cookie": [v for n, v in pairs if n.lower() == "set-cookie"], "body": body, "ttfb_ms": first}

    schema = pa.schema([("url", pa.string()), ("final_url", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("set_cookie", pa.list_(pa.string())), ("body", pa.string()), ("ttfb_ms", pa.int64()), ("error", pa.string())])
    return wanted.mapInArrow(_rows(["url", "bad"], ask, threads, schema), ANSWERS)


def names(questions: DataFrame, resolvers: tuple[str, ...] = RESOLVERS, timeout: float = 6, threads: int = 8) -> DataFrame:
    """name, type, ok, answers of questions to name servers over HTTPS.

    Resolvers are asked in order until one gives a proof; ok is false if none
    does, which is not the same as no answers.  Quotes around answers go.
    """

    def ask(name, kind):
        from urllib.parse import urlencode

        for resolver in resolvers if name and kind else ():
            try:
                told = json.loads(_open(f"{resolver}?{urlencode({'name': name, 'type': kind})}", timeout, "application/dns-json")[3])
            except Exception:  # noqa: BLE001  the next resolver is asked
                continue
            if told.get("Status") in PROVES:
                return {"name": name, "type": kind, "ok": True, "answers": [re.sub('^"|"$', "", str(a.get("data", ""))) for a in told.get("Answer") or ()]}
        return {"name": name, "type": kind, "ok": False, "answers": []}

    schema = pa.schema([("name", pa.string()), ("type", pa.string()), ("ok", pa.bool_()), ("answers", pa.list_(pa.string()))])
    return questions.select("name", "type").distinct().mapInArrow(_rows(["name", "type"], ask, threads, schema), "name string, type string, ok boolean, answers array<string>")


def certificates(hosts: DataFrame, port: int = 443, timeout: float = 6, threads: int = 8) -> DataFrame:
    """host, valid_to (timestamp), issuer, subject, error of the certificate that each host shows."""

    def ask(host):
        import socket
        import ssl

        try:
            with socket.create_connection((host, port), timeout) as plain, ssl.create_default_context().wrap_socket(plain, server_hostname=host) as secure:
                shown = secure.getpeercert()
        except Exception as e:  # noqa: BLE001  whatever a server does is an answer
            return {"host": host, "error": f"{type(e).__name__}: {e}"[:200]}
        name = lambda who: next((v for part in shown.get(who, ()) for k, v in part if k in ("organizationName", "commonName")), None)
        return {"host": host, "ends": ssl.cert_time_to_seconds(shown["notAfter"]), "issuer": name("issuer"), "subject": name("subject")}

    schema = pa.schema([("host", pa.string()), ("ends", pa.int64()), ("issuer", pa.string()), ("subject", pa.string()), ("error", pa.string())])
    got = hosts.select("host").distinct().mapInArrow(_rows(["host"], ask, threads, schema), "host string, ends long, issuer string, subject string, error string")
    return got.select("host", F.timestamp_seconds("ends").alias("valid_to"), "issuer", "subject", "error")


def head(answers: DataFrame, most: int = 4000) -> DataFrame:
    """The answers with the first characters of their bodies only."""
    return answers.withColumn("body", F.substring("body", 1, most))


def scope(targets: DataFrame, **options) -> DataFrame:
    """One row of facts about each site: url, headers, body, status, robots, sitemap, llms, security_txt.

    A file is there if it was answered with a status from 200 to 299; `robots_body` is the start of that text.
    """
    from quarry.operators.links import origin

    paths = {"robots": "/robots.txt", "sitemap": "/sitemap.xml", "llms": "/llms.txt", "security_txt": "/.well-known/security.txt"}
    sites = targets.select("url").distinct().withColumn("own", origin(F.col("url")))
    wanted = sites.select(F.col("url").alias("site"), F.explode(F.array(F.struct(F.lit("home").alias("part"), F.col("url").alias("url")), *[F.struct(F.lit(n).alias("part"), F.concat("own", F.lit(p)).alias("url")) for n, p in paths.items()])).alias("w")).select("site", "w.*")
    got = wanted.join(responses(wanted, **options), "url")
    there = F.col("status").between(200, 299)
    home = lambda c: F.max_by(F.col(c), F.when(F.col("part") == "home", F.lit(1)))
    return got.groupBy(F.col("site").alias("url")).agg(
        *[home(c).alias(c) for c in ("headers", "body", "status")],
        *[F.coalesce(F.bool_or(F.when(F.col("part") == n, there)), F.lit(False)).alias(n) for n in paths],
        F.max(F.when((F.col("part") == "robots") & there, F.substring("body", 1, 4000))).alias("robots_body"),
    )
