"""The HTML rules as joins over pages, start tags and attributes.

A page becomes its start tags (one Arrow function, whose narrow result is written once), these become rows, and every rule is an
expression over them. URL values are made distinct and classified by joins. What a rule changes is an edit (place, place, text);
all findings, edits and references of a page come together in one aggregation, which is joined to the pages once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup
from ..policy import Policy
from ..sources.staging import cut
from .urls import classify_urls, origin_allowed

#: The attributes that hold URLs, in the order in which they are checked.
URL_ATTRIBUTES = ("href", "src", "action", "formaction", "data", "poster")
ACTION = "struct<rule_id:string,category:string,location:struct<line:bigint,byte_offset:bigint>,original:string,action:string,replacement:string>"
REFERENCE = "struct<raw:string,kind:string>"


def attribute(attrs: Column, name: str) -> Column:
    """The value of an attribute, null without it."""
    return F.get(F.filter(attrs, lambda a: a["name"] == name), F.lit(0))["value"]


def start_tags(pages: DataFrame) -> DataFrame:
    """(id, n, tag, start, end, until, line, attrs): the start tags of each page's ``data``, numbered in order; none of unreadable pages."""
    tags = pages.select("id", F.posexplode(markup.elements(F.col("data"))).alias("n", "e"))
    return tags.select("id", "n", "e.*")


def consumed(tags: DataFrame, policy: Policy) -> DataFrame:
    """The tags with ``rule`` (of the element rule that takes the whole element, else null), ``act`` and no tag inside a taken element."""
    rules = policy.html
    allowed = lambda target, origins: F.lit(False) if not origins else origin_allowed(target, F.array(*[F.lit(x) for x in origins]))
    src, data = attribute(F.col("attrs"), "src"), attribute(F.col("attrs"), "data")
    script = (F.col("tag") == "script") & F.lit(rules.action_script != "allow") & ~F.coalesce(allowed(src, rules.script_allowlist), F.lit(False))
    target = F.when(F.col("tag") == "object", data).otherwise(src)
    frame = F.col("tag").isin("iframe", "object", "embed") & F.lit(rules.action_frame != "allow") & ~F.coalesce(allowed(target, rules.frame_origin_allowlist), F.lit(False))
    refresh = F.lower(F.trim(attribute(F.col("attrs"), "http-equiv"))) == "refresh"
    meta = (F.col("tag") == "meta") & F.lit(rules.action_meta_refresh != "allow") & F.coalesce(refresh, F.lit(False))
    tags = tags.withColumn("rule", F.when(script, "html.script.disallowed").when(frame, "html.frame.disallowed").when(meta, "html.meta.refresh"))
    tags = tags.withColumn("act", F.when(script, rules.action_script).when(frame, rules.action_frame).when(meta, rules.action_meta_refresh))
    before = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.max(F.when(F.col("rule").isNotNull(), F.col("until"))).over(before)
    return tags.withColumn("covered", covered).where(F.coalesce(F.col("start") >= F.col("covered"), F.lit(True))).drop("covered")


def finding_rows(tags: DataFrame) -> DataFrame:
    """One row for each tag that an element rule took (null ``name``), and for each attribute of the others: (id, n, tag, start, end,
    until, line, rule, act, sheet, k, name, value, plain, a_start, a_end). ``sheet`` tells links to style sheets."""
    sheet = (F.col("tag") == "link") & F.array_contains(F.split(F.lower(attribute(F.col("attrs"), "rel")), r"\s+"), "stylesheet")
    none = F.array(F.lit(None).cast("struct<name:string,value:string,plain:string,start:int,end:int>"))
    rows = tags.withColumn("sheet", F.coalesce(sheet, F.lit(False))).withColumn("attrs", F.when(F.col("rule").isNotNull(), none).otherwise(F.col("attrs")))
    rows = rows.select("id", "n", "tag", "start", "end", "until", "line", "rule", "act", "sheet", F.posexplode("attrs").alias("k", "a"))
    named = [F.col("a.name").alias("name"), F.col("a.value").alias("value"), F.coalesce("a.plain", "a.value").alias("plain"), F.col("a.start").alias("a_start"), F.col("a.end").alias("a_end")]
    return rows.select("id", "n", "tag", "start", "end", "until", "line", "rule", "act", "sheet", "k", *named)


def judged_attributes(attrs: DataFrame, policy: Policy, blocklist: DataFrame, protected: DataFrame, networks: DataFrame) -> DataFrame:
    """The rows with rule_id, category, act, replacement, stage and order; null rule_id for those without finding."""
    rules, urls = policy.html, policy.urls
    is_url = F.coalesce(F.col("name").isin(*URL_ATTRIBUTES), F.lit(False))
    bad = is_url & markup.dangerous_scheme(F.when(is_url, F.col("plain"))) & F.lit(rules.action_dangerous_scheme != "allow")
    handler = F.coalesce(F.lower(F.substring("name", 1, 2)) == "on", F.lit(False))
    attrs = attrs.withColumn("bad", bad).withColumn("handler", handler & F.lit(rules.action_event_handler != "allow"))
    verdicts = classify_urls(attrs.where(is_url & ~F.col("bad")).select(F.col("value").alias("url")), blocklist, protected, networks)
    attrs = attrs.join(verdicts.withColumnRenamed("rule", "network"), is_url & ~F.col("bad") & (F.col("value") == F.col("url")), "left")
    whole = F.col("rule").isNotNull()
    label, respelled = F.col("label"), F.col("canonical").isNotNull()
    cases = (
        ("blocked", "url.blocklist", "blocklist", urls.action_blocked), ("homograph", "url.homograph", "homograph", urls.action_homograph),
        ("userinfo", "url.userinfo", "host_spoof", urls.action_userinfo), ("malformed", "url.malformed", "malformed", urls.action_blocked),
        ("idn", "url.idn", "idn_url", urls.action_idn),
    )
    rule = F.when(whole, F.col("rule")).when(F.col("handler"), "html.attr.event_handler").when(F.col("bad"), "html.attr.dangerous_scheme").when(label == "internal", F.col("network")).when((label == "clean") & respelled, "url.normalised")
    category = F.when(whole | F.col("handler") | F.col("bad"), "xss").when(label == "internal", "ssrf").when((label == "clean") & respelled, "host_spoof")
    act = (F.when(whole, F.col("act")).when(F.col("handler"), rules.action_event_handler).when(F.col("bad"), rules.action_dangerous_scheme).when(label == "internal", urls.action_internal)
           .when((label == "clean") & respelled, urls.action_normalised).when((label == "idn") & ~respelled, "allow"))
    for name, rule_id, of, action in cases:
        rule, category, act = rule.when(label == name, rule_id), category.when(label == name, of), act.when(label == name, action)
    attrs = attrs.withColumn("rule_id", rule).withColumn("category", category).withColumn("act", act)
    target = F.coalesce("canonical", F.lit(urls.placeholder_url))
    replaced = ~F.col("handler") & ~F.col("act").isin("allow", "remove")
    target = F.when(whole, F.lit(rules.placeholder_frame)).otherwise(target)
    replaced = F.when(whole, F.col("act") == "placeholder").otherwise(replaced)
    stage = F.when(whole, -1).when(F.col("handler"), 0).when(F.col("bad"), 1).otherwise(2)
    order = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in URL_ATTRIBUTES]), F.col("name")), F.lit(0))
    return attrs.withColumn("replacement", F.when(replaced, target)).withColumn("stage", stage).withColumn("order", F.when(F.col("handler"), F.col("k")).otherwise(order))


def page_findings(pages: DataFrame, policy: Policy, blocklist: DataFrame, protected: DataFrame, networks: DataFrame) -> DataFrame:
    """(id, readable, found, edits, refused, refs, base): one narrow row for each page (id, data) that has any of these."""
    parsed = cut(pages.select("id", markup.elements(F.col("data")).alias("tags")))
    tags = consumed(parsed.select("id", F.posexplode("tags").alias("n", "e")).select("id", "n", "e.*"), policy)
    rows = judged_attributes(finding_rows(tags), policy, blocklist, protected, networks)
    whole = F.col("rule").isNotNull()
    hit, value = F.col("rule_id").isNotNull(), F.replace(F.col("replacement"), F.lit('"'), F.lit("&quot;"))
    text = (F.when(whole, F.coalesce("replacement", F.lit(""))).when(F.col("handler") | (F.col("act") == "remove"), "")
            .otherwise(F.concat(F.lit(" "), F.col("name"), F.lit('="'), value, F.lit('"'))))
    edit = F.struct(F.when(whole, F.col("start")).otherwise(F.col("a_start")).alias("start"), F.when(whole, F.col("until")).otherwise(F.col("a_end")).alias("end"), text.alias("text"))
    place = F.struct("n", "stage", F.col("order").cast("int").alias("order"))
    original = markup.fragment(F.when(~whole, F.concat("name", F.lit('="'), "value", F.lit('"'))))
    finding = F.struct(place.alias("at"), "rule_id", "category", "start", "line", original.alias("original"), F.when(whole, F.col("end")).alias("tag_end"), F.col("act").alias("action"), "replacement")
    base = (F.col("tag") == "base") & (F.col("name") == "href")
    found = rows.groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(hit, finding))).alias("found"), F.array_sort(F.collect_list(F.when(hit & (F.col("act") != "allow"), edit))).alias("edits"),
        F.bool_or(F.coalesce(hit & (F.col("act") == "refuse"), F.lit(False))).alias("refused"), F.array_sort(F.flatten(F.collect_list(references()))).alias("refs"),
        F.min_by(F.coalesce("replacement", "value"), F.when(base, F.col("n"))).alias("base"))
    unreadable = parsed.where(F.col("tags").isNull()).select("id", F.lit(False).alias("readable"))
    return found.withColumn("readable", F.lit(True)).unionByName(unreadable, allowMissingColumns=True)


def sanitize(pages: DataFrame, policy: Policy, blocklist: DataFrame, protected: DataFrame, networks: DataFrame, is_page: Column | None = None) -> DataFrame:
    """The rows of ``pages`` (id, data and other columns) with output, actions, refused, references and base.

    Rows that ``is_page`` rules out are not looked at. Actions are in document order. ``output`` is null for refused pages, and
    pages that can't be read for sure are refused. Null data is an empty page; ids must be distinct.
    """
    is_page = F.lit(True) if is_page is None else is_page
    found = page_findings(pages.where(is_page).select("id", "data"), policy, blocklist, protected, networks)
    joined = pages.withColumn("data", F.coalesce("data", F.lit(b""))).join(found.withColumnRenamed("id", "_of"), F.col("id") == F.col("_of"), "left").drop("_of")

    def action(x: Column) -> Column:
        tag = F.make_valid_utf8(F.substring(F.col("data"), x["start"] + 1, F.least(x["tag_end"] - x["start"], F.lit(200))).cast("string"))
        place = F.struct(x["line"].cast("bigint").alias("line"), x["start"].cast("bigint").alias("byte_offset"))
        return F.struct(x["rule_id"].alias("rule_id"), x["category"].alias("category"), place.alias("location"), F.coalesce(x["original"], tag).alias("original"), x["action"].alias("action"), x["replacement"].alias("replacement"))

    refused = F.coalesce(F.col("refused") | ~F.col("readable"), ~F.col("readable"), F.lit(False))
    changed = F.coalesce(F.size("edits") > 0, F.lit(False)) & ~refused
    out = joined.withColumn("output", F.when(changed, markup.spliced(F.when(changed, F.col("data")), F.when(changed, F.col("edits")))).when(~refused, F.col("data")))
    return out.select(
        *pages.columns, "output", F.coalesce(F.transform("found", action), F.array().cast(f"array<{ACTION}>")).alias("actions"), refused.alias("refused"),
        F.coalesce(F.transform("refs", lambda r: F.struct(r["raw"].alias("raw"), r["kind"].alias("kind"))), F.array().cast(f"array<{REFERENCE}>")).alias("references"), "base")


def references() -> Column:
    """What a row of ``judged_attributes`` refers to, as it reads after the rules: stylesheets, scripts, images, sources."""
    value = F.trim(F.coalesce("replacement", "value"))
    ref = lambda m, raw, kind: F.struct(F.col("n"), F.col("k"), m.alias("m"), raw.alias("raw"), kind.alias("kind"))
    single = F.when(F.col("sheet") & (F.col("name") == "href"), F.lit("css")).when(F.col("name") == "src", F.when(F.col("tag") == "script", F.lit("js")).when(F.col("tag").isin("img", "source"), F.lit("image")))
    several = F.transform(F.split("value", ","), lambda c, m: ref(m, F.split(F.trim(c), r"\s+")[0], F.lit("image")))
    all_of = F.when((F.col("tag") == "source") & (F.col("name") == "srcset"), several).when(single.isNotNull(), F.array(ref(F.lit(0), value, single)))
    return F.filter(F.when(F.col("rule").isNull(), all_of), lambda r: r["raw"] != "")


def rewrite_references(pages: DataFrame) -> DataFrame:
    """(id, output) of pages (id, data, rewrites): references in the map ``rewrites`` (as written, trimmed) become what it gives.

    Links, scripts, images and sources are rewritten; in a ``srcset`` each candidate by itself, its descriptor stays. Without a
    map, or with an empty one, the bytes stay the same.
    """
    wanted = pages.where(F.size("rewrites") > 0)
    tags = start_tags(wanted.select("id", "data")).where(F.col("tag").isin("link", "script", "img", "source"))
    attrs = tags.select("id", F.explode("attrs").alias("a")).select("id", "a.*").where(F.col("name").isin("href", "src", "srcset"))
    attrs = attrs.join(wanted.select("id", "rewrites"), "id")
    trimmed = F.trim("value")

    def candidate(c: Column) -> Column:
        url = F.regexp_extract(F.trim(c), r"^(\S*)", 1)
        return F.concat(F.coalesce(F.element_at("rewrites", url), url), F.regexp_replace(F.regexp_extract(F.trim(c), r"^\S*(\s.*)?$", 1), r"^\s+", " "))

    target = F.when(F.col("name") == "srcset", F.array_join(F.transform(F.split("value", ","), candidate), ", ")).otherwise(F.element_at("rewrites", trimmed))
    changed = attrs.withColumn("to", target).where(F.col("to").isNotNull() & (F.col("to") != F.col("value")))
    text = F.concat(F.lit(" "), "name", F.lit('="'), F.replace("to", F.lit('"'), F.lit("&quot;")), F.lit('"'))
    edits = changed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", text.alias("text")))).alias("edits"))
    joined = pages.select("id", "data").join(edits, "id", "left")
    return joined.select("id", F.when(F.col("edits").isNull(), F.col("data")).otherwise(markup.spliced(F.col("data"), F.col("edits"))).alias("output"))
