"""Every query of the engine against its SQL in DuckDB."""

import math

import duckdb
import pytest

from quarry import site_queries as queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return str(value)[:19] if hasattr(value, "isoformat") else value


def rows(names, found):
    order = sorted(names)
    return sorted(([repr(plain(r[names.index(c)])) for c in order] for r in found))


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows(spark, sf_dir, duck, name):
    df = queries.QUERIES[name](spark, sf_dir)
    cursor = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(list(df.columns), [tuple(r) for r in df.collect()]) == rows(names, cursor.fetchall())


def test_every_rule_fires_and_misses(duck):
    from collections import Counter

    from quarry import oracles, site_queries

    told = Counter(r[3] for r in duck.execute(queries.ORACLE["page_rules_fixture"]).fetchall())
    assert all(0 < told[rule[1]] < len(site_queries._PAGE_ROWS) for rule in oracles.PAGE_RULES)
    for name, rules in (("secret_rules_fixture", oracles.SECRET_LINES), ("sast_lines", oracles.CODE_LINES), ("data_rules", oracles.DATA_LINES)):
        cursor = duck.execute(queries.ORACLE[name])
        at = [d[0] for d in cursor.description].index("rule")
        told = {r[at] for r in cursor.fetchall()}
        assert told == {line.split()[0] for line in rules.strip().splitlines()}, name


def test_word_boundaries_have_one_side_where_that_is_enough():
    import re

    from quarry.plans.expr import AFTER, BEFORE, EDGE, java

    assert java(r"\bsk_[a-z]{3}\b") == AFTER + "sk_[a-z]{3}" + BEFORE
    assert java(r"\b(?:a|b)c\b|<p\b[^>]*\bx") == f"{AFTER}(?:a|b)c{BEFORE}|<p{BEFORE}[^>]*{AFTER}x"
    assert java(r"(?i)\b(?:a|<b>)\b") == f"(?i){EDGE}(?:a|<b>){EDGE}"
    assert java(r"[^}]*\b") == "[^}]*" + EDGE and java(r"[a-]{3}\b") == "[a-]{3}" + EDGE
    for pattern in (r"\b(le|la)\b", r"1(?:\.0)?\b", r"\b[a-z][a-z0-9]*\.(?:title|cta)\b", r"x\b|\by"):
        for text in ("le", "xle", "la.", "1.0", "1.05", "11", "a.title", "a.titles", "é.cta", "x y", "xy", ""):
            assert bool(re.search(java(pattern), text, re.A)) == bool(re.search(pattern, text, re.A)), (pattern, text)


def test_ids_follow_the_hash(spark, sf_dir):
    from quarry.functions.text import base36, djb2
    from pyspark.sql import functions as F

    def brute(s):
        h = 5381
        for c in s:
            h = (h * 33 + ord(c)) % 2**32
        digits, out = "0123456789abcdefghijklmnopqrstuvwxyz", ""
        while h:
            h, d = divmod(h, 36)
            out = digits[d] + out
        return out

    texts = ["", "no-lang:g:0", "missing-title:https://x.fr/:12"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(base36(djb2(F.col("t")))).collect()]
    assert got == [brute(t) for t in texts]


def test_rules_fire_once_for_each_page(spark):
    from quarry.plans import page_rules

    html = """<html><head><script src="a.js"></script></head><body><h1>Hi</h1><h1>There</h1><img src=x><input type="text" name="q">
    <label>Mail <input name="mail"></label><a href="/a"></a><form><input type="text" id="a"><select></select></form></body></html>"""
    found = {r["rule"] for r in page_rules.findings(spark.createDataFrame([(1, "https://x.io/", html), (2, "https://x.io/b", None)], "page_id long, url string, html string")).where("page_id = 1").collect()}
    assert {"multiple-h1", "img-no-alt", "input-no-label", "render-blocking-js", "empty-link", "no-lang", "weak-value-prop"} <= found
    assert "missing-h1" not in found and "long-form" not in found


def test_stream_counts_match_batch(spark, sf_dir, tmp_path):
    from quarry.streaming.quota import counts_per_window

    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "user_id", "cast(ts as timestamp) ts")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = counts_per_window(stream).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == events.count()


def test_stream_admits_like_the_batch(spark, sf_dir, tmp_path):
    from quarry.streaming.quota import admit_stream, admitted

    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "user_id", "cast(ts as timestamp) ts")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = admit_stream(stream, 86400, 1).writeStream.outputMode("append").format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = {r["event_id"]: r["allowed"] for r in spark.sql("SELECT * FROM admitted").collect()}
    want = {r["event_id"]: r["user_ok"] for r in admitted(events, 86400, 1, 10**9).collect()}
    assert got == want


def test_repository_reader(spark, tmp_path):
    from quarry.plans import line_rules
    from quarry.sources import readers

    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.js").write_text("eval(x)\n")
    (tmp_path / "src" / "b.bin").write_text("eval(x)\n")
    (tmp_path / "src" / "c.py").write_bytes(b"eval(x)\0")
    (tmp_path / "node_modules" / "d.js").write_text("eval(x)\n")
    files = readers.repository(spark, str(tmp_path))
    found = line_rules.matches(line_rules.lines(files, "file", "text", "lang"), line_rules.CODE).collect()
    assert [(r["file"][-4:], r["n"], r["rule"]) for r in found] == [("a.js", 1, "js-eval")]


def test_colours():
    from quarry.functions.css import colour

    assert colour(" White ") == (255, 255, 255, 1.0)
    assert colour("#0f8") == (0, 255, 136, 1.0)
    assert colour("#11223380") == (17, 34, 51, 128 / 255)
    assert colour("rgb(10, 20 , 300)") == (10, 20, 255, 1.0)
    assert colour("rgba(100% 0% 50% / 25%)") == (255, 0, 127, 0.25)  # 50 * 2.55 is a little under 127.5
    for other in (None, "", "inherit", "hsl(1,2%,3%)", "var(--x)", "#12", "#12345", "rgb(var(--x))", "rgb(1,2)", "linear-gradient(red, blue)"):
        assert colour(other) is None


def test_cascade():
    from quarry.functions.css import Cascade

    c = Cascade(["p{color:a} .x{color:b} p.x.y{color:c} #i{color:d} .x{color:e} ul p{color:z} *{color:z} [a]{color:z}", "@media x{p:hover,b{font-size:9px}}"])
    of = lambda tag, name=None, *classes: c.of(tag, name, frozenset(classes)).get("color")
    assert (of("p"), of("b"), of("b", None, "x"), of("p", None, "x", "y"), of("p", "i", "x", "y")) == ("a", None, "e", "c", "d")
    assert c.of("b", None, frozenset())["font-size"] == "9px"


def test_odd_pages_have_boxes():
    from quarry.operators.contrast import boxes

    for html in ("", "<", "</p></b>", "<p" * 20_000, "<script>" * 20_000, "<b>" * 20_000 + "</i>" * 20_000, "<style>p{color:red", "\0<p style='color:'>é</p>", "<p style=\"font-size:1.2.3px;font-weight:bolder\">x</p>"):
        boxes(html, [html])
    every, base = boxes("<html style='background:#000'><body><p>a<b>c</p>d</body></html>", [])
    assert base == (0, 0, 0, 1.0) and [(b.tag, "".join(b.text)) for b in every] == [("html", ""), ("body", "d"), ("p", "a"), ("b", "c")]


@pytest.fixture
def site():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlparse

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            path = urlparse(self.path)
            status, kind, body = {"/": (200, "text/html", "<p>é</p>"), "/robots.txt": (200, "text/plain", "User-agent: *"), "/logo": (200, "image/png", "x"), "/bad-dns": (500, "text/plain", ""), "/a": (200, "text/html", '<a href="./b/">b</a><a href="https://other.io/x">o</a><link rel="stylesheet" href="/s.css">'), "/b": (200, "text/html", '<a href="/gone">g</a><a href="../x.png">i</a>'), "/s.css": (200, "text/css", "p{color:#999}")}.get(path.path, (404, "text/plain", "none"))
            if path.path == "/dns":
                known = parse_qs(path.query)["name"] == ["a.io"]
                status, kind, body = 200, "application/json", json.dumps({"Status": 0, "Answer": [{"data": '"v=spf1"'}]} if known else {"Status": 3})
            self.send_response(status)
            self.send_header("Content-Type", kind + "; charset=utf-8")
            self.send_header("Set-Cookie", "a=1")
            self.send_header("Set-Cookie", "b=2")
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages_are_fetched(spark, site):
    from quarry.sources import fetch

    urls = spark.createDataFrame([(site + "/",), (site + "/no",), (site + "/logo",), ("http://127.0.0.1:1/",), ("ftp://x/",), (None,)], "url string")
    got = {r["url"]: r for r in fetch.responses(urls, guard=False).collect()}
    assert len(got) == 6 and got[site + "/"]["body"] == "<p>é</p>" and got[site + "/"]["set_cookie"] == ["a=1", "b=2"] and got[site + "/"]["ttfb_ms"] >= 0
    assert (got[site + "/no"]["status"], got[site + "/no"]["error"]) == (404, None) and got[site + "/logo"]["body"] == ""
    assert got["http://127.0.0.1:1/"]["status"] is None and got["ftp://x/"]["error"] == "scheme" and got[None]["error"]
    guarded = {r["url"]: r["error"] for r in fetch.responses(urls).collect()}
    assert guarded[site + "/"] == "blocked" and guarded["ftp://x/"] == "scheme" and guarded[None] == "empty"
    facts = fetch.scope(urls.limit(1), guard=False).first()
    assert (facts["robots"], facts["sitemap"], facts["robots_body"], facts["status"]) == (True, False, "User-agent: *", 200)


def test_sites_are_crawled(spark, site):
    from quarry.sources import site as sites

    seeds = spark.createDataFrame([(site,), (site + "/a#x",)], "url string")
    got = {r["url"]: (r["depth"], r["status"]) for r in sites.crawl(seeds, guard=False).collect()}
    assert got == {site + "/": (0, 200), site + "/a": (0, 200), site + "/b": (1, 200), site + "/gone": (2, 404)}
    few = sites.crawl(seeds, max_pages=3, guard=False)
    assert sorted(r["url"] for r in few.collect()) == [site + "/", site + "/a", site + "/b"]
    broken = {r["url"]: r["status"] for r in sites.broken_links(few, guard=False).collect()}
    assert broken == {site + "/gone": 404}
    sheets = sites.style_sheets(few.select("url", "html"), guard=False).collect()
    assert [(r["url"], r["css"]) for r in sheets] == [(site + "/s.css", "p{color:#999}")]


def test_mail_questions(spark):
    from quarry.sources.site import SELECTORS, mail_questions

    asked = mail_questions(spark.createDataFrame([("www.a.io",), ("a.io",)], "domain string")).collect()
    assert len(asked) == 3 + len(SELECTORS) and {(r["kind"], r["name"], r["type"]) for r in asked} >= {("mx", "a.io", "MX"), ("dmarc", "_dmarc.a.io", "TXT"), ("dkim", "google._domainkey.a.io", "TXT")}


def test_sheets_that_are_too_large_to_send_whole(spark, monkeypatch):
    from quarry.operators import contrast

    whole = queries.QUERIES["low_contrast"](spark, "").collect()
    monkeypatch.setattr(contrast, "SMALL", 0)
    assert sorted(map(tuple, queries.QUERIES["low_contrast"](spark, "").collect())) == sorted(map(tuple, whole))


def test_names_are_asked_in_order(spark, site):
    from quarry.sources import fetch

    asked = spark.createDataFrame([("a.io", "TXT"), ("b.io", "TXT")], "name string, type string")
    got = lambda *paths: {r["name"]: (r["ok"], r["answers"]) for r in fetch.names(asked, tuple(site + p for p in paths)).collect()}
    assert got("/bad-dns", "/dns") == {"a.io": (True, ["v=spf1"]), "b.io": (True, [])}
    assert got("/bad-dns") == {"a.io": (False, []), "b.io": (False, [])}
    cert = fetch.certificates(spark.createDataFrame([("127.0.0.1",)], "host string"), port=1, timeout=1).first()
    assert cert["valid_to"] is None and cert["error"]


def test_runs_of_all_agents(spark):
    from quarry import registry
    from quarry.operators import canonical, findings

    pages = spark.createDataFrame([(1, "https://a.io/", "<p>x</p>", 200, None), (2, "https://a.io/gone", "", 404, None)], "page_id long, url string, html string, status int, error string")
    files = spark.createDataFrame([("a", "m.js", "js", "eval(x) // TODO"), ("a", ".env", "env", "A=1")], "repo string, file string, lang string, text string")
    responses = spark.createDataFrame([("http://a.io/", {"server": "x/1"}, None)], "url string, headers map<string,string>, probe_origin string")
    found = registry.run(spark, {"pages": pages, "files": files, "responses": responses})
    got = {(r["agent"], r["rule"]) for r in found.collect()}
    assert {("seo", "missing-title"), ("security", "js-eval"), ("code-arch", "todo-debt"), ("infra", "env-committed"), ("security", "no-tls"), ("perf", "weak-cache")} <= got
    assert not found.where("url = 'https://a.io/gone'").count()
    assert {r["agent"] for r in registry.run(spark, {"pages": pages}, active=("seo", "ux")).select("agent").distinct().collect()} == {"seo", "ux"}
    broken = registry.run(spark, {"pages": pages}, runners={"seo": [registry.pages], "ux": [lambda f: f["pages"].select("nothing")]}, active=("seo", "ux"))
    assert {r["rule"] for r in broken.where("agent = 'ux'").collect()} == {"agent-error"} and broken.where("agent = 'seo'").count() > 3
    scope = spark.createDataFrame([("https://a.io", "gtag(", True, True, True, True)], "site string, body string, sitemap boolean, robots boolean, llms boolean, security_txt boolean")
    merged = registry.audit(spark, {"pages": pages}, scope)
    assert not merged.where("rule = 'no-analytics'").count() and merged.where("rule = 'missing-title'").count() == 1
    assert merged.columns[:2] == ["site", "loc_key"] and canonical.synthesis(merged).count() == 1 and findings.top(merged.withColumn("verdict", merged["check.verdict"]).withColumn("seq", merged["emit_seq"]), 3).count() == 3
    assert registry.run(spark, {}).count() == 0


def test_store_is_read_back(spark, tmp_path):
    from quarry.operators import canonical
    from quarry.sinks import writers
    from quarry.sources import readers

    rows = [("a1", "https://x", "done", 80, "acme"), ("a2", "https://y", "error", None, "beta")]
    audits = spark.createDataFrame(rows, "id string, target string, status string, score int, tenant string")
    writers.save(audits, str(tmp_path / "audits"))
    writers.save(audits.where("tenant = 'beta'").withColumn("status", audits["id"]), str(tmp_path / "audits"))
    got = {r["id"]: (r["status"], r["tenant"]) for r in readers.audits(spark, str(tmp_path / "audits")).collect()}
    assert got == {"a1": ("done", "acme"), "a2": ("a2", "beta")}
    assert readers.audits(spark, str(tmp_path / "none")).count() == 0 and readers.optional(spark, str(tmp_path / "no"), readers.SCANNER).columns == ["results"]
    raw = spark.createDataFrame([("s", "seo", "r", "high", "CWE-1", "https://s/")], "site string, agent string, rule string, severity string, cwe string, url string")
    merged = canonical.merge(canonical.canonical(raw)).selectExpr("'a1' AS audit_id", "*")
    for _ in range(2):
        writers.insert_findings(merged, str(tmp_path / "findings"))
    back = spark.read.parquet(str(tmp_path / "findings"))
    assert back.count() == 2 and back.first()["cwe"] == "CWE-1" and back.first()["location"]["url"] == "https://s/"


def test_messages_and_exit_code(spark):
    from quarry.sinks import writers

    f = spark.createDataFrame([(1, "seo", "low-one", "low", "confirmed", 0.1), (2, "ux", "bad-one", "critical", "confirmed", 0.5), (3, "ux", "odd", "high", "confirmed", 0.2)], "seq long, agent string, rule string, severity string, verdict string, effort double")
    assert writers.exit_code(f) == 1 and writers.exit_code(f.where("severity = 'low'")) == 0
    text = writers.chat_message(f, "a.io", 74).split("\n")
    assert text[0] == "[WARN] a.io 74/100" and [t.split(": ")[0] for t in text[1:]] == ["- critical", "- high", "- low"]
    assert sorted(r["value"] for r in writers.lines_of_json(f.select("seq", "rule")).collect())[0] == '{"seq":1,"rule":"low-one"}'
    assert writers.without_fixes(f.withColumn("fix", f["rule"])).columns == f.columns
    told = f.selectExpr("*", "seq AS priority", "concat('<', rule) AS proof", "'mend' AS fix")
    domains = spark.createDataFrame([("a<b", 1, 90, 2, False), ("c", 2, None, 0, False), ("d", 3, 88, 1, True)], "agent string, agent_n int, score long, n long, partial boolean")
    page = "".join(writers.report(domains, "T", 74, told))
    assert page.index("74/100: good base") < page.index("a&lt;b") < page.index("not evaluated") < page.index("<h2>Strengths</h2><p>a&lt;b</p>") < page.index("P0: urgent") < page.index("P1: ") < page.index("&lt;low-one<br>mend")
    assert "mend" not in "".join(writers.report(domains, "T", 74, told, locked=True)) and "P0" not in "".join(writers.report(domains, "T"))
    body = writers.message(f, {"weighted_score": 74, "total_findings": 3, "critical": 1, "low": 1, "effort_days": 0.8, "risk_low": 1400, "risk_high": 7000}, "a.io", 2)
    assert body["text"] == "a.io: 74/100, 3 findings" and body["blocks"][1]["fields"][3] == "Risk 1 400 - 7 000 EUR" and body["blocks"][2]["text"] == "1 critical  1 low" and body["blocks"][-1]["text"].split("\n")[0] == "critical: bad-one (ux)"
    assert writers.message(f.where("false"), {}, "a.io")["blocks"][2]["text"] == "0 findings"
    assert writers.printed(f, 1) == ["1 critical   1 high   0 medium   1 low   0 info", "[critical] bad-one (ux)"]


def test_requests_are_checked():
    from quarry.registry import Request

    assert (Request("a.io", max_pages=99).max_pages, Request("https://a.io/x", max_pages=0).max_pages, Request("A.io:8080?x").max_pages) == (30, 1, 1)
    assert Request("a.io", monthly_visits=10, conversion_value=2).business() == {"visits": 10, "value": 2, "rate": 0.02}
    for bad in ({"target": ""}, {"target": "ftp://a.io"}, {"target": "a.io", "repo": "git@x"}, {"target": "a.io", "conversion_rate": -1}):
        with pytest.raises(ValueError):
            Request(**bad)


def test_new_faults_are_told_once(spark, tmp_path):
    from quarry.streaming.watch import Watch

    told = []
    watch = Watch(str(tmp_path / "store"), lambda df: told.append(sorted(map(tuple, df.collect()))))
    schema = "target string, audit_id string, at int, key string, severity string, seq bigint"
    batches = [
        [("x", "1", 1, "k1", "high", 1), ("y", "9", 1, "k1", "high", 1)],
        [("x", "2", 2, "k1", "high", 1), ("x", "2", 2, "k2", "critical", 2), ("x", "2", 2, "k3", "low", 3), ("z", "5", 2, "k", "high", 1)],
        [("y", "10", 3, "k7", "medium", 1), ("x", "3", 3, "k1", "high", 1)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    q = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")).writeStream.foreachBatch(watch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert told == [[("x", "k2", "critical")], [("y", "k7", "medium")]]
    watch(spark.createDataFrame(batches[1], schema), 1)  # run again after a failure
    assert told[-1] == told[0]


def test_audits_wait_for_their_turn(spark):
    from quarry.streaming.watch import in_turn

    def job(n):
        return lambda: spark.range(n).count() if n else 1 / 0

    got = in_turn(spark, [job(3), job(0), job(5), job(7)], at_once=2)
    assert got[0] == 3 and isinstance(got[1], ZeroDivisionError) and got[2:] == [5, 7]


def test_events_of_one_audit(spark):
    from quarry.streaming.quota import of_audit

    assert [r["seq"] for r in of_audit(spark.createDataFrame([("x", 1), ("y", 2)], "id string, seq int"), "y").collect()] == [2]


def test_repository_signals(spark):
    from quarry.sources import readers

    files = spark.createDataFrame([("a", '{"dependencies":{"pg":"1"},"devDependencies":{"x":"1"}}'), ("b", '{"devDependencies":{"nodemailer":"1"}}'), ("c", "no json")], "file string, text string")
    assert sorted(map(tuple, readers.packages(files).collect())) == [("a", True, False), ("b", False, True), ("c", False, False)]
    env = spark.createDataFrame([("x/.env",), (".env.example",), ("a/.env.local",), ("env",)], "file string")
    assert sorted(r["file"] for r in readers.committed_env(env).collect()) == ["a/.env.local", "x/.env"]


def test_a_broken_agent_is_a_finding(spark):
    from quarry import audit

    scope = spark.createDataFrame([("r", "high")], "rule string, severity string")
    got = audit.isolated(spark, {"seo": lambda s: s, "geo": lambda s: s.select("nothing")}, scope).collect()
    assert sorted(map(tuple, got)) == [("geo", "agent-error", "info"), ("seo", "r", "high")]
