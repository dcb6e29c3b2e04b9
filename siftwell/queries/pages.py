"""Queries over ``pages``: types, rules, references, budgets, look-ups by host, and the whole sanitiser."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hosts, netaddr, sniff
from ..operators import urls
from ..plans import guard, pipeline, subresources
from ..policy import Budgets, Policy, SubresourceRules, UrlRules
from ..sources.inputs import from_pages, safe_name
from ..sources.staging import cut

BLOCKED = ("example.org", "ads.example.com", "m.ththth.example.net")
PROTECTED = ("google.com", "apple.com", "paypal.com", "microsoft.com", "amazon.com")
POLICY = Policy(urls=UrlRules(protected_domains=PROTECTED))
#: Pieces of markup, the rules that they break and what is left of them.
HOSTILE = {
    "<!--><script>alert(1)</script>-->": ("html.script.disallowed", "<!-->-->"), "<!---><img src=x onerror=a()>-->": ("html.attr.event_handler", "<!---><img src=x>-->"),
    "<a href=jav&#97;script:x>b</a>": ("html.attr.dangerous_scheme", '<a href="#blocked">b</a>'), "<iframe src=//x.example><b></b></iframe>": ("html.frame.disallowed", '<div class="sanitized-placeholder"></div>'),
    "<meta http-equiv=Refresh content=0>": ("html.meta.refresh", ""), "<form action=http://127.0.0.1/>": ("ssrf.loopback", '<form action="#blocked">'), "<b title='<script>'>": ("", "<b title='<script>'>"),
    "<video poster=data:x><a href=//ads.example.com>": ("html.attr.dangerous_scheme,url.blocklist", '<video poster="#blocked"><a href="#blocked">'), "<svg><p><style><a>": (None, None),
    "<select><xmp><script>a()</script></xmp></select>": (None, None), "<frameset><style><frame src='javascript:a()'></style>": (None, None), "<noscript><style></noscript><script>a()</script></style>": (None, None),
    "<noscript><!-- </noscript><script>a()</script> -->": (None, None), "<svg><desc><div></svg></div></desc><style><script>a()</script></style></svg>": (None, None), "<div><svg></div><![CDATA[><script>a()</script>]]></svg>": (None, None),
    "<noscript><img src=x onerror=a()></noscript>": ("html.attr.event_handler", "<noscript><img src=x></noscript>"), "<svg><title>t</title><path onload=a() /></svg><script>a()</script>": ("html.attr.event_handler,html.script.disallowed", "<svg><title>t</title><path /></svg>"),
    "<select><option onclick=a()>o</select><style>p{}</style>": ("html.attr.event_handler", "<select><option>o</select><style>p{}</style>"), "<svg><style><a href=javascript:a()>b</a></style></svg>": ("html.attr.dangerous_scheme", '<svg><style><a href="#blocked">b</a></style></svg>'),
}
#: Pieces of style sheets, the rules that they break, and what is left of them where active content is taken out (null: nothing of the whole sheet).
HOSTILE_SHEETS = {
    'a{content:"/*"} input[value^=a]{background:url(//e/a)} c{content:"*/"}': ("scan.css.exfiltration", 'a{content:"/*"}  c{content:"*/"}'), 'a{content:"/*"} b{width:expression(1)} c{content:"*/"}': ("scan.css.expression", 'a{content:"/*"}  c{content:"*/"}'),
    r'@\69mport "x";': ("scan.css.import", ""), "a{width:expr/**/ession(1)}": ("scan.css.expression", None), r"@media screen{d{background:\75rl(\6a avascript:x)} e{color:red}}": ("scan.css.dangerous_scheme", "@media screen{ e{color:red}}"),
    "@imp@import 'x';ort 'x';": ("scan.css.import", "ort 'x';"), "a{x:url(data:image/png;base64,AA)}": ("", "a{x:url(data:image/png;base64,AA)}"), 'a[href$=".pdf"]{color:red} b{background:url(x)}': ("", 'a[href$=".pdf"]{color:red} b{background:url(x)}'),
    'a{background:url("javascript:x\n)}': ("scan.css.dangerous_scheme", ""), "a{-moz-binding:url(x#y)} b{x:expr/**/ession(1)}": ("scan.css.expression", None), "@import url(javascript:x);": ("scan.css.import,scan.css.dangerous_scheme", ""),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lists(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The block-list, the protected names and the denied networks of the queries."""
    lines = spark.createDataFrame([(f"0.0.0.0 {d} # blocked",) for d in BLOCKED], "value string")
    return urls.blocklist_rows(lines), urls.protected_table(spark, list(PROTECTED)), netaddr.deny_table(spark)


def reports(spark: SparkSession, sf_dir: str, policy: Policy = POLICY) -> DataFrame:
    return pipeline.process(from_pages(read(spark, sf_dir, "pages")), policy, *lists(spark))


def page_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports(spark, sf_dir)
    scripts = F.size(F.filter("actions", lambda a: a["rule_id"] == "html.script.disallowed"))
    return rows.select(F.col("id").alias("page_id"), "status", "bucket", "bytes_in", "bytes_out", F.size("actions").cast("long").alias("n_actions"), scripts.cast("long").alias("n_scripts"), F.sha2("output", 256).alias("output_sha256"))


def page_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports(spark, sf_dir).select(F.explode("actions").alias("a"))
    return rows.groupBy(F.col("a.rule_id").alias("rule_id"), F.col("a.category").alias("category"), F.col("a.action").alias("action")).agg(F.count("*").alias("n"))


def page_action_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports(spark, sf_dir).select("id", F.posexplode("actions").alias("n", "a")).where("a.rule_id = 'html.script.disallowed'")
    return rows.select(F.col("id").alias("page_id"), F.col("a.location.line").alias("line"), F.col("a.location.byte_offset").alias("byte_offset"), F.col("a.original").alias("original"))


def page_type_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").withColumn("k", F.col("page_id") % 4)
    header = F.element_at(F.array(F.lit("text/html; charset=utf-8"), F.lit(None).cast("string"), F.lit("Application/PDF"), F.lit("x/unknown")), (F.col("k") + 1).cast("int"))
    name = F.when(F.col("k") == 1, "a/b.tar.PNG").when(F.col("k") == 3, ".htm").otherwise("x")
    declared, sniffed = sniff.declared(header, name), sniff.sniffed(F.encode("html", "UTF-8"))
    rows = pages.select(declared.alias("declared"), sniffed.alias("sniffed"), sniff.effective(sniffed, declared).alias("effective"), sniff.mismatch_text(sniffed, declared).alias("mismatch"))
    return rows.groupBy("declared", "sniffed", "effective", "mismatch").agg(F.count("*").alias("n"))


def page_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.run_summary(reports(spark, sf_dir))


def page_byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports(spark, sf_dir, replace(POLICY, budgets=Budgets(max_input_bytes=1500)))
    state = F.when(F.col("status") == "budget_exceeded", "budget_exceeded").otherwise("within")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.sum("bytes_in").alias("bytes"))


def hostile_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a hostile piece put before their end: comments that end early, handlers, schemes, frames, unreadable markup."""
    piece = F.element_at(F.array(*[F.lit(x) for x in HOSTILE]), (F.col("page_id") % len(HOSTILE) + 1).cast("int"))
    pages = read(spark, sf_dir, "pages").withColumn("html", F.concat(F.lit("<!DOCTYPE html>"), piece, F.lit("<p>"), F.col("page_id").cast("string")))
    rows = pipeline.process(from_pages(pages), POLICY, *lists(spark))
    return rows.select(F.col("id").alias("page_id"), "status", F.array_join(F.transform("actions", lambda a: a["rule_id"]), ",").alias("rules"), F.col("output").cast("string").alias("output"))


def hostile_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A style sheet for each page: a hostile piece between two rules of the page's own; refused as it is, and with its active content taken out."""
    piece, number = F.element_at(F.array(*[F.lit(x) for x in HOSTILE_SHEETS]), (F.col("page_id") % len(HOSTILE_SHEETS) + 1).cast("int")), F.col("page_id").cast("string")
    sheet = F.concat(F.lit("p"), number, F.lit("{color:red}\n"), piece, F.lit("\nq{margin:"), number, F.lit("px}"))
    sheets = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("s.css").alias("name"), F.encode(sheet, "UTF-8").alias("data"), F.lit("text/css").alias("declared_header"))
    asis = pipeline.process(sheets, POLICY, *lists(spark)).select("id", "status", F.array_join(F.transform("actions", lambda a: a["rule_id"]), ",").alias("rules"))
    kept = pipeline.process(sheets, replace(POLICY, subresources=SubresourceRules(active_content_rule="allow")), *lists(spark)).select("id", F.col("output").cast("string").alias("kept"))
    return asis.join(kept, "id").withColumnRenamed("id", "page_id")


def blocked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").withColumn("host", urls.taken_apart(F.col("url"))["host"])
    named = pages.select(F.col("host").alias("ascii"), F.lit("domain").alias("kind")).distinct()
    listed = urls.blocked_hosts(named, lists(spark)[0])
    return pages.join(listed, pages["host"] == listed["ascii"], "left_semi").select("page_id", "host")


def url_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.classify_urls(read(spark, sf_dir, "pages").select("url"), *lists(spark))
    return found.groupBy("label").agg(F.count("*").alias("n"))


def url_verdicts_hostile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page hosts respelled in hostile ways: look-alikes, credentials, internal addresses, control characters."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]*(.*)$", 1).alias("path"))
    heads = F.array(*[F.lit(x) for x in ("http://paypal.com", "http://login.pаypal.com", "http://rnicrosoft.com", "https://user:pw@example.net", "http://127.0.0.1", "http://0x7f.1", "http://[::ffff:10.0.0.1]", "http://xn--mnchen-3ya.de", "HTTP://Example.COM:80", "http://a\u0001b.com", "//ads.example.com", "mailto:x")])
    rows = pages.select(F.concat(F.element_at(heads, (F.col("page_id") % 12 + 1).cast("int")), F.when(F.col("page_id") % 12 == 11, "").otherwise(F.col("path"))).alias("url"))
    found = urls.classify_urls(rows, *lists(spark))
    return found.groupBy("label", "rule").agg(F.count("*").alias("n"), F.count("canonical").alias("n_canonical"))


#: Ways to write a protected name, and what each is: one that looks like it, the name itself, or another one.
LOOKALIKES = {
    "pаypal.com": "homograph", "раураl.com": "homograph", "xn--pypal-4ve.com": "homograph", "ｐaypa1.com": "homograph", "𝐩𝐚𝐲𝐩𝐚𝟏.com": "homograph", "rnicrosoft.com": "homograph", "microsоft.com": "homograph", "gооgle.com": "homograph",
    "goog1e.com": "homograph", "аpple.com": "homograph", "αpple.com": "homograph", "arnazon.com": "homograph", "αmazоn.com": "homograph", "pаypаl.com.evil.net": "idn", "ｐaypal.com": "clean", "paypaⅼ.com": "clean", "𝒑𝒂𝒚𝒑𝒂𝒍.com": "clean",
    "paypal.com.evil.net": "clean", "paypals.com": "clean",
}


def lookalike_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' addresses at hosts below names that look like protected ones: mixed scripts, full width, mathematical letters, punycode."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/]*(.*)$", 1).alias("path"))
    name = F.element_at(F.array(*[F.lit(x) for x in LOOKALIKES]), (F.col("page_id") % len(LOOKALIKES) + 1).cast("int"))
    rows = cut(pages.select("page_id", F.concat(F.lit("http://w"), (F.col("page_id") % 100).cast("string"), F.lit("."), name, F.col("path")).alias("url")))
    found = urls.classify_urls(rows, *lists(spark))
    return rows.join(found, "url").select("page_id", "label")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.html import attribute, start_tags

    tags = start_tags(read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.encode("html", "UTF-8").alias("data")))
    rows = tags.where("tag = 'a'").select("id", attribute(F.col("attrs"), "href").alias("href")).where("href IS NOT NULL")
    return rows.groupBy(F.col("id").alias("page_id")).agg(F.count("*").alias("n_links"), F.countDistinct("href").alias("n_distinct"))


def reference_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subresources.slots(linked(spark, sf_dir), 3)
    return found.groupBy("over").agg(F.count("*").alias("n"), F.max("slot").cast("long").alias("last_slot"))


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' links as references to images: a table of reports as ``subresources.slots`` reads it."""
    from ..operators.html import attribute, start_tags

    pages = read(spark, sf_dir, "pages")
    tags = start_tags(pages.select(F.col("page_id").alias("id"), F.encode("html", "UTF-8").alias("data"))).where("tag = 'a'")
    refs = tags.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", attribute(F.col("attrs"), "href").alias("raw")))).alias("r"))
    rows = refs.join(pages.select(F.col("page_id").alias("id"), F.col("url").alias("page_url")), "id")
    return rows.select("id", "page_url", F.lit(None).cast("string").alias("base"), F.transform("r", lambda x: F.struct(x["raw"].alias("raw"), F.lit("image").alias("kind"))).alias("references"))


def subresource_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of sizes that follow from their addresses, every third one a style sheet with an import; a page has 900 bytes."""
    asked = cut(subresources.slots(linked(spark, sf_dir), 32))
    size, sheet = F.length("url") % 7 * 100, F.length("url") % 3 == 0
    body = F.when(sheet, F.encode(F.rpad(F.lit("@import url(x);"), size.cast("int"), " "), "UTF-8")).otherwise(
        F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.encode(F.repeat(F.lit("x"), (size - 8).cast("int")), "UTF-8")))
    kind = F.when(sheet, "text/css").otherwise("image/png")
    responses = asked.select("url").distinct().select("url", F.when(F.length("url") % 11 == 0, 404).otherwise(200).alias("status"), kind.alias("content_type"), F.when(size > 0, body).alias("body"), F.lit(None).cast("string").alias("failure"))
    policy = Policy(subresources=SubresourceRules(max_total_bytes=900))
    found = subresources.outcomes(asked, responses, policy, subresources.bodies(responses, policy, *lists(spark)))
    return found.groupBy("status", "rule").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def guarded_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with references to its own host, to internal ones, over a redirect to one, to a sheet that is refused, with credentials, to a
    host without an answer, and to an image that the rest of the byte budget decides. Hosts of pages are internal for two in five."""
    k, png = F.col("page_id") % 5, F.unhex(F.lit("89504E470D0A1A0A"))
    host = F.concat(F.lit("http://own"), k.cast("string"), F.lit(".example"))
    own = F.when(k == 4, F.concat(host, F.lit(":81/p/a.png"))).otherwise("a.png")
    number = F.col("page_id").cast("string")
    tags = F.concat(F.lit("<!DOCTYPE html><img src='"), own, F.lit("'><img src=http://in.example/b.png><img src=http://far.example/hop/"), number, F.lit(".png><link rel=stylesheet href=http://far.example/s"), k.cast("string"),
                    F.lit("><img src=http://u:p@far.example/c.png><img src=http://gone.example/d.png><img src=http://far.example/e.png>"))
    pages = read(spark, sf_dir, "pages")
    inputs = pages.select(F.col("page_id").alias("id"), F.concat(host, F.lit("/p/"), number, F.lit(".html")).alias("name"), F.encode(F.concat(tags, "html"), "UTF-8").alias("data"), F.lit("text/html").alias("declared_header"))
    image = lambda size: F.concat(png, F.encode(F.repeat(F.lit("x"), size - 8), "UTF-8"))
    none = F.lit(None).cast("string")
    hops = pages.select(F.concat(F.lit("http://far.example/hop/"), number, F.lit(".png")).alias("url"), F.lit(302).alias("status"), F.lit("//in.example/x").alias("location"), none.alias("content_type"), F.lit(None).cast("binary").alias("body"))
    mine = pages.select(F.concat(host, F.when(k == 4, ":81").otherwise(""), F.lit("/p/a.png")).alias("url"), F.when(k == 1, 404).otherwise(200).alias("status"), none.alias("location"), F.lit("image/png").alias("content_type"), image(40).alias("body")).distinct()
    sheets = pages.select(F.concat(F.lit("http://far.example/s"), k.cast("string")).alias("url"), F.lit(200).alias("status"), none.alias("location"), none.alias("content_type"), F.encode(F.lit("@import url(x);"), "UTF-8").alias("body")).distinct()
    others = spark.createDataFrame([("http://in.example/b.png",), ("http://in.example/x",), ("http://far.example/c.png",), ("http://gone.example/d.png",), ("http://far.example/e.png",)], "url string")
    others = others.select("url", F.lit(200).alias("status"), none.alias("location"), F.lit("image/png").alias("content_type"), image(10).alias("body"))
    responses = hops.unionByName(mine).unionByName(sheets).unionByName(others)
    names = pages.select(F.concat(F.lit("own"), k.cast("string"), F.lit(".example")).alias("host"), F.lpad(F.when(k > 2, F.concat(F.lit("0a00000"), k.cast("string"))).otherwise("08080808"), 32, "0").alias("digits")).distinct()
    names = names.unionByName(spark.createDataFrame([("in.example", "c0a80001"), ("far.example", "08080404")], "host string, digits string").withColumn("digits", F.lpad("digits", 32, "0")))
    dns = names.select("host", F.lit(0).alias("ord"), F.lit(4).alias("family"), "digits")
    policy = replace(POLICY, urls=replace(POLICY.urls, action_userinfo="allow"), subresources=SubresourceRules(max_total_bytes=60))
    reports, _ = subresources.sanitise_whole(inputs, responses, policy, *lists(spark), dns=dns)
    rows = reports.select(F.col("id").alias("page_id"), F.explode("subresources").alias("s"))
    return rows.select("page_id", F.col("s.slot").cast("long").alias("slot"), F.col("s.status").alias("status"), F.col("s.rule").alias("rule"), F.col("s.bytes").alias("bytes")).where("slot < 7")


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", safe_name(F.col("page_id"), F.col("url")).alias("name"))


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pipeline.report_json(reports(spark, sf_dir))
    return rows.select(F.col("id").alias("page_id"), F.get_json_object("report", "$.status").alias("status"), F.length("report").cast("long").alias("n_chars"))


def redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of redirects: of every seven pages the first answers, the last goes in a circle, the sixth leaves http; locations are relative for even pages."""
    pages = read(spark, sf_dir, "pages").select("page_id")
    address = lambda n: F.concat(F.lit("http://h.example/p/"), n.cast("string"))
    k = F.col("page_id") % 7
    to = F.col("page_id") - F.when(k == 6, 0).otherwise(1)
    location = F.when(k == 5, "ftp://h.example/").when(F.col("page_id") % 2 == 0, F.concat(F.lit("../p/"), to.cast("string"))).otherwise(address(to))
    answers = pages.select(address(F.col("page_id")).alias("url"), F.when(k == 0, 200).when(k == 6, 302).otherwise(301).alias("status"), F.when(k > 0, location).alias("location"))
    found = guard.follow(pages.select(F.col("page_id").alias("request_id"), address(F.col("page_id")).alias("url")), answers, 3)
    return found.groupBy("outcome", "hops").agg(F.count("*").alias("n"))


def host_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select(urls.taken_apart(F.col("url"))["host"].alias("host"))
    return rows.select(F.explode(hosts.suffixes(F.col("host"))).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    page_reports, page_rule_counts, page_action_places, page_type_matrix, page_run_summary, page_byte_budget, hostile_pages, hostile_sheets, blocked_pages, url_labels, url_verdicts_hostile, lookalike_hosts,
    page_links, reference_slots, subresource_outcomes, guarded_references, output_names, report_json, redirects, host_suffixes)}

_SCRIPTS = "regexp_extract_all(html, '<script[^>]*>')"
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_HREFS = "SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) href, generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), 1) n FROM pages"
_SLOTS = f"""WITH r AS ({_HREFS}), a AS (SELECT page_id, n, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href ELSE href END u FROM r WHERE href <> '' AND href NOT LIKE '#%'),
  f AS (SELECT page_id, regexp_replace(u, '#.*$', '') u, min(n) n FROM a GROUP BY 1, 2), s AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 slot FROM f)"""
_OUT = "regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gs')"
_TEXT = lambda x: "NULL" if x is None else "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
ORACLES = {
    "hostile_sheets": "WITH h AS (SELECT page_id, page_id % " + str(len(HOSTILE_SHEETS)) + " AS k FROM pages), v AS (SELECT * FROM (VALUES " + ", ".join(
        f"({k}, {_TEXT(rules)}, {_TEXT(out)})" for k, (rules, out) in enumerate(HOSTILE_SHEETS.values())) + ''') v(k, rules, output))
  SELECT page_id, CASE WHEN rules = '' THEN 'clean' ELSE 'refused' END AS status, rules, CASE WHEN output IS NULL THEN '' ELSE 'p' || page_id || '{color:red}' || chr(10) || output || chr(10) || 'q{margin:' || page_id || 'px}' END AS kept FROM h JOIN v USING (k)''',
    "page_byte_budget": "SELECT CASE WHEN strlen(html) > 1500 THEN 'budget_exceeded' ELSE 'within' END AS state, count(*) AS n, sum(strlen(html))::BIGINT AS bytes FROM pages GROUP BY 1",
    "page_reports": f"SELECT page_id, CASE WHEN len({_SCRIPTS}) > 0 THEN 'sanitised' ELSE 'clean' END AS status, 'ok' AS bucket, strlen(html)::BIGINT AS bytes_in, strlen({_OUT})::BIGINT AS bytes_out, len({_SCRIPTS})::BIGINT AS n_actions, len({_SCRIPTS})::BIGINT AS n_scripts, sha256({_OUT}) AS output_sha256 FROM pages",
    "page_rule_counts": f"SELECT 'html.script.disallowed' AS rule_id, 'xss' AS category, 'remove' AS action, sum(len({_SCRIPTS}))::BIGINT AS n FROM pages",
    "page_action_places": "SELECT page_id, (len(split_part(html, '<script', 1)) - len(replace(split_part(html, '<script', 1), chr(10), '')) + 1)::BIGINT AS line, strlen(split_part(html, '<script', 1))::BIGINT AS byte_offset, regexp_extract(html, '<script[^>]*>') AS original FROM pages WHERE html LIKE '%<script%'",
    "page_type_matrix": """WITH d AS (SELECT CASE page_id % 4 WHEN 0 THEN 'text/html' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/pdf' END AS declared,
  CASE WHEN html LIKE '<!DOCTYPE html>%' OR html LIKE '<!doctype html>%' THEN 'text/html' END AS sniffed FROM pages)
  SELECT declared, sniffed, coalesce(sniffed, declared) AS effective, CASE WHEN declared <> sniffed THEN 'declared=' || declared || ' sniffed=' || sniffed END AS mismatch, count(*) AS n FROM d GROUP BY ALL""",
    "page_run_summary": "SELECT count(*) AS inputs_total, count(*) AS inputs_ok, 0::BIGINT AS inputs_refused, 0::BIGINT AS inputs_errored, 0::BIGINT AS subresources_fetched, 0::BIGINT AS subresources_refused, 0::BIGINT AS ssrf_blocked FROM pages",
    "blocked_pages": f"WITH h AS (SELECT page_id, {_HOST} host FROM pages) SELECT page_id, host FROM h WHERE " + " OR ".join(f"host = '{d}' OR host LIKE '%.{d}'" for d in BLOCKED),
    "url_labels": f"WITH h AS (SELECT DISTINCT url, {_HOST} host FROM pages) SELECT CASE WHEN " + " OR ".join(f"host = '{d}' OR host LIKE '%.{d}'" for d in BLOCKED) + " THEN 'blocked' ELSE 'clean' END AS label, count(*) AS n FROM h GROUP BY 1",
    "url_verdicts_hostile": """WITH u AS (SELECT DISTINCT page_id % 12 AS k, CASE WHEN page_id % 12 = 11 THEN '' ELSE regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1) END AS path FROM pages)
  SELECT (['clean', 'homograph', 'homograph', 'userinfo', 'internal', 'internal', 'internal', 'idn', 'clean', 'malformed', 'blocked', 'clean'])[k + 1] AS label, CASE WHEN k IN (4, 5) THEN 'ssrf.loopback' WHEN k = 6 THEN 'ssrf.private' END AS rule,
    count(*) AS n, count(CASE WHEN k IN (3, 8) THEN 1 END) AS n_canonical FROM u GROUP BY 1, 2""",
    "lookalike_hosts": "SELECT page_id, ([" + ", ".join(f"'{x}'" for x in LOOKALIKES.values()) + f"])[page_id % {len(LOOKALIKES)} + 1] AS label FROM pages",
    "page_links": f"SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_distinct FROM ({_HREFS}) GROUP BY 1",
    "reference_slots": f"{_SLOTS} SELECT slot >= 3 AS over, count(*) AS n, max(slot)::BIGINT AS last_slot FROM s GROUP BY 1",
    "output_names": "SELECT page_id, page_id || '-' || regexp_replace(split_part(rtrim(url, '/'), '/', -1), '[^A-Za-z0-9._-]', '_', 'g') AS name FROM pages",
    "redirects": """WITH RECURSIVE f AS (SELECT page_id, page_id AS p, 0 AS hops FROM pages UNION ALL SELECT page_id, CASE WHEN p % 7 = 6 THEN p ELSE p - 1 END, hops + 1 FROM f WHERE p % 7 NOT IN (0, 5) AND hops < 3)
  SELECT CASE WHEN p % 7 = 0 THEN 'fetched' WHEN p % 7 = 5 AND hops < 3 THEN 'bad_scheme' ELSE 'too_many' END AS outcome, hops, count(*) AS n FROM (SELECT page_id, arg_max(p, hops) p, max(hops) hops FROM f GROUP BY 1) GROUP BY ALL""",
    "hostile_pages": "WITH h AS (SELECT page_id, page_id % " + str(len(HOSTILE)) + " AS k FROM pages), v AS (SELECT * FROM (VALUES " + ", ".join(
        f"({k}, {'NULL' if rules is None else repr(rules)}, " + ("NULL" if out is None else "'" + out.replace("'", "''") + "'") + ")" for k, (rules, out) in enumerate(HOSTILE.values())) + ''') v(k, rules, output))
  SELECT page_id, CASE WHEN output IS NULL THEN 'refused' WHEN rules = '' THEN 'clean' ELSE 'sanitised' END AS status, coalesce(rules, '') AS rules, '<!DOCTYPE html>' || output || '<p>' || page_id AS output FROM h JOIN v USING (k)''',
    "subresource_outcomes": f"""{_SLOTS.replace("WITH r AS", "WITH RECURSIVE r AS", 1)}, t AS (SELECT page_id, slot, length(u) % 7 * 100 AS size, CASE WHEN slot >= 32 THEN 'budget_exceeded' WHEN length(u) % 11 = 0 THEN 'fetch_error' WHEN length(u) % 3 = 0 AND length(u) % 7 > 0 THEN 'refused' ELSE 'clean' END AS st FROM s),
  fold AS (SELECT page_id, -1::BIGINT AS slot, 0::BIGINT AS used, NULL::VARCHAR AS status, 0::BIGINT AS bytes FROM (SELECT DISTINCT page_id FROM t) UNION ALL
    SELECT t.page_id, t.slot, used + CASE WHEN st = 'clean' AND size <= 900 - used THEN size ELSE 0 END, CASE WHEN st IN ('clean', 'refused') AND size > 900 - used THEN 'budget_exceeded' ELSE st END, CASE WHEN st = 'clean' AND size <= 900 - used THEN size ELSE 0 END
    FROM fold JOIN t ON t.page_id = fold.page_id AND t.slot = fold.slot + 1)
  SELECT status, CASE WHEN status IN ('refused', 'budget_exceeded') THEN 'subresource.' || status END AS rule, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM fold WHERE slot >= 0 GROUP BY 1, 2""",
    "guarded_references": """WITH s AS (SELECT page_id, page_id % 5 AS k, unnest(range(7)) AS slot FROM pages), t AS (SELECT *, CASE WHEN slot = 0 THEN CASE k WHEN 1 THEN 'fetch_error' WHEN 4 THEN 'ssrf_blocked' ELSE 'clean' END
    WHEN slot IN (1, 2) THEN 'ssrf_blocked' WHEN slot IN (3, 4) THEN 'refused' WHEN slot = 5 THEN 'fetch_error' WHEN k IN (1, 4) THEN 'clean' ELSE 'budget_exceeded' END AS status FROM s)
  SELECT page_id, slot, status, CASE WHEN status NOT IN ('clean', 'fetch_error') THEN 'subresource.' || status END AS rule, (CASE WHEN status = 'clean' THEN CASE slot WHEN 0 THEN 40 ELSE 10 END ELSE 0 END)::BIGINT AS bytes FROM t""",
    "report_json": f"""WITH p AS (SELECT *, len({_SCRIPTS}) AS n, strlen({_OUT}) AS left_over, split_part(html, '<script', 1) AS head FROM pages)
  SELECT page_id, CASE WHEN n > 0 THEN 'sanitised' ELSE 'clean' END AS status, length('{{"id":' || page_id || ',"name":' || to_json(url) || ',"status":"' || CASE WHEN n > 0 THEN 'sanitised' ELSE 'clean' END || '","bytes_in":' || strlen(html) || ',"bytes_out":' || left_over
    || ',"declared_mime":"text/html","sniffed_mime":' || CASE WHEN lower(html) LIKE '<!doctype html>%' THEN '"text/html"' ELSE 'null' END || ',"actions":[' || CASE WHEN n > 0 THEN '{{"rule_id":"html.script.disallowed","category":"xss","location":{{"line":' || len(head) - len(replace(head, chr(10), '')) + 1
    || ',"byte_offset":' || strlen(head) || '}},"original":' || to_json(regexp_extract(html, '<script[^>]*>')) || ',"action":"remove","replacement":null}}' ELSE '' END || ']}}')::BIGINT AS n_chars FROM p""",
    "host_suffixes": f"WITH h AS (SELECT string_split({_HOST}, '.') l FROM pages), s AS (SELECT l, unnest(range(1, len(l) + 1)) i FROM h) SELECT array_to_string(l[i:], '.') AS suffix, count(*) AS n FROM s GROUP BY 1",
}
