"""URL verdicts by joins: distinct URLs are taken apart by expressions, hosts are parsed once each, and block-lists, look-alikes
and networks are joined to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import confusables, hosts, netaddr
from ..sources.staging import cut

SPECIAL = ("http", "https", "ftp", "ws", "wss")
#: Default ports.
PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}


#: What stands before a URL's authority: a special scheme with any slashes, or two slashes with or without another scheme.
BEFORE = r"(?i)^(?:(?:https?|ftp|wss?):[/\\]*|(?:[a-z][a-z0-9+.\-]*:)?//)"
_USER, _HOST = r"(?:[^/?#\\]*@)?", r"(?:\[[^\]]*\]|[^/?#\\:\[@]*)"


def taken_apart(raw: Column) -> Column:
    """A struct of a URL's parts: scheme, relative (no scheme, no host), protocol_relative, authority, userinfo, host, port, rest.

    Every part is one expression over the text, so that plans which use many parts stay small.
    """
    text = F.trim(raw)
    part = lambda pattern: F.regexp_extract(text, BEFORE + pattern, 1)
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return F.struct(
        scheme.alias("scheme"), (~F.regexp_like(text, F.lit(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:|//)"))).alias("relative"), text.startswith("//").alias("protocol_relative"),
        F.when(F.regexp_like(text, F.lit(BEFORE)), part(r"([^/?#\\]*)")).alias("authority"), F.when(F.regexp_like(text, F.lit(BEFORE + r"[^/?#\\]*@")), part(r"([^/?#\\]*)@")).alias("userinfo"),
        part(f"{_USER}({_HOST[3:]}").alias("host"), part(f"{_USER}{_HOST}:([^/?#\\\\@]*)(?:[/?#\\\\]|$)").alias("port"), part(r"[^/?#\\]*((?s:.*))$").alias("rest"))


def blocklist_rows(lines: DataFrame) -> DataFrame:
    """(domain, line): the names of hosts-file lines (column ``value``); comments, blank lines and stock local names are dropped.

    Raises on a line without a name after an address, and on a name that is listed twice.
    """
    # fixed values: names that every stock hosts file maps
    stock = ("localhost", "localhost.localdomain", "broadcasthost", "ip6-localhost", "ip6-loopback", "ip6-allnodes", "ip6-allrouters", "ip6-allhosts")
    tokens = lines.select(F.split(F.trim(F.split("value", "#")[0]), r"\s+").alias("t")).where(F.get("t", F.lit(0)) != "")
    rows = tokens.select("t", F.explode(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))).alias("name"))
    rows = rows.select(F.rtrim(F.lower("name"), F.lit(".")).alias("domain")).where(~F.col("domain").isin(*stock))
    if not tokens.where(F.size("t") < 2).isEmpty():
        raise ValueError("a block-list line is '<address> <name> [alias ...]'")
    if not rows.groupBy("domain").count().where("count > 1").isEmpty():
        raise ValueError("a name is listed twice")
    return rows


def blocked_hosts(parsed: DataFrame, blocklist: DataFrame) -> DataFrame:
    """The distinct ``ascii`` hosts that are listed, or below a listed name."""
    names = parsed.where("kind = 'domain'").select("ascii").distinct().select("ascii", F.explode(hosts.suffixes(F.col("ascii"))).alias("domain"))
    return names.join(blocklist.select("domain").distinct(), "domain", "left_semi").select("ascii").distinct()


def lookalike_hosts(parsed: DataFrame, protected: DataFrame) -> DataFrame:
    """The distinct ``ascii`` hosts that look like a protected ``domain`` (or are below one that does) without being it.

    The longest suffix that looks like a protected name decides. ``protected`` is that of ``protected_table``.
    """
    names = parsed.where("kind = 'domain'").select("ascii", F.lower("unicode").alias("shown")).distinct()
    pairs = protected.select(F.explode("confusables").alias("character", "prototype"))
    shapes = confusables.skeletons(names, pairs, "shown").withColumnRenamed("name", "shown")
    parts = confusables.skeleton_parts(F.col("shown"), F.col("skeleton"), hosts.suffixes)
    names = names.join(shapes, "shown").select("ascii", F.posexplode(parts).alias("at", "p")).select("ascii", "at", "p.*")
    known = protected.groupBy("skeleton").agg(F.max_by("domain", "ord").alias("domain"))  # of two with one skeleton the last counts
    first = names.join(known, "skeleton").groupBy("ascii").agg(F.min_by(F.col("suffix") != F.col("domain"), "at").alias("differs"))
    return first.where("differs").select("ascii")


def classify_urls(urls: DataFrame, blocklist: DataFrame, protected: DataFrame, networks: DataFrame) -> DataFrame:
    """(url, label, rule, canonical) for each distinct ``url``.

    In this order: control characters or an invalid host or port make a URL ``malformed``; one without a host is ``clean``;
    then ``blocked``, ``homograph``, ``internal`` (``rule`` names the network), ``userinfo`` (``canonical`` is without it), ``idn``.
    ``canonical`` is also given if the authority isn't written as it is read. Null URLs are left out.
    """
    rows = urls.select("url").where(F.col("url").isNotNull()).distinct()
    rows = rows.select("url", F.explode(F.array(taken_apart(F.col("url")))).alias("p"))  # a row each: the parts are worked out once, not at each use
    named = rows.select(F.col("p.host").alias("host")).where(F.col("host") != "").distinct().withColumn("h", hosts.parsed_host(F.col("host")))
    parsed = cut(named.where(F.col("h").isNotNull()).select("host", "h.*"))  # distinct hosts; four joins read them
    addresses = parsed.where("kind != 'domain'").select("ascii", F.when(F.col("kind") == "ipv4", 4).otherwise(6).alias("of_family"), "digits").distinct()
    internal = netaddr.classify(addresses, networks, "ascii", "of_family", "digits")
    info = (parsed.join(blocked_hosts(parsed, blocklist).withColumn("blocked", F.lit(True)), "ascii", "left")
            .join(lookalike_hosts(parsed, protected).withColumn("lookalike", F.lit(True)), "ascii", "left").join(internal, "ascii", "left"))
    rows = rows.join(info, rows["p.host"] == info["host"], "left").drop("host")
    port = F.regexp_replace("p.port", "^0+(?=.)", "")
    bad_port = (F.col("p.port") != "") & (~F.regexp_like("p.port", F.lit("^[0-9]+$")) | (F.expr("try_cast(p.port AS int)") > 65535) | F.expr("try_cast(p.port AS int)").isNull())
    has_host = F.col("p.authority").isNotNull()
    special = F.col("p.scheme").isin(*SPECIAL) | F.col("p.protocol_relative")
    malformed = F.regexp_like("url", F.lit("[\\x00-\\x1F\\x7F]")) | (has_host & (bad_port | (special & F.col("kind").isNull())))
    ports = F.create_map(*[F.lit(x) for kv in PORTS.items() for x in kv])
    shown_port = F.when((port == "") | (port == F.coalesce(ports[F.col("p.scheme")], F.lit(""))), "").otherwise(F.concat(F.lit(":"), port))
    user = F.regexp_replace(F.coalesce("p.userinfo", F.lit("")), ":$", "")
    bare = F.concat(F.coalesce("ascii", "p.host"), shown_port)
    authority = F.when(user == "", bare).otherwise(F.concat(user, F.lit("@"), bare))
    head = F.when(F.col("p.protocol_relative"), "//").otherwise(F.concat("p.scheme", F.lit("://")))
    path = F.when(F.regexp_like("p.rest", F.lit(r"^[/\\]")), F.regexp_replace("p.rest", r"^\\", "/")).otherwise(F.concat(F.lit("/"), "p.rest"))
    label = (F.when(malformed, "malformed").when(~has_host | F.col("p.relative"), "clean").when(F.col("blocked"), "blocked").when(F.col("lookalike"), "homograph")
             .when(F.col("rule").isNotNull(), "internal").when(user != "", "userinfo").when(F.regexp_like(F.coalesce("ascii", F.lit("")), F.lit(r"(^|\.)xn--")), "idn").otherwise("clean"))
    written = F.regexp_extract(F.trim("url"), "^[^/?#]*//([^/?#]*)", 1)
    respelled = has_host & (F.lower(written) != F.lower(authority))
    canonical = (F.when(F.col("label") == "userinfo", F.concat(head, bare, path)).when(F.col("label").isin("idn", "clean") & respelled, F.concat(head, authority, path)))
    return rows.withColumn("label", label).select("url", "label", F.when(F.col("label") == "internal", F.col("rule")).alias("rule"), canonical.alias("canonical"))


def origin_allowed(target: Column, allowed: Column) -> Column:
    """Whether a URL's origin or bare host is in an array; an empty array allows nothing, nor is a relative URL ever allowed."""
    p = taken_apart(target)
    origin = F.concat(p["scheme"], F.lit("://"), F.lower(p["host"]), F.when(p["port"] == "", "").otherwise(F.concat(F.lit(":"), p["port"])))
    return F.coalesce((p["scheme"] != "") & (F.array_contains(allowed, origin) | F.array_contains(allowed, F.lower(p["host"]))), F.lit(False))


def protected_table(spark: SparkSession, domains: list[str], confusables_path: str = "") -> DataFrame:
    """(ord, domain, skeleton, confusables): the protected names as a reader sees them, and what they look like; the first row has the relation
    of characters by which names are compared (see ``functions.confusables``), with those of the file that the policy names.

    Names are parsed as hosts (punycode is decoded, letters are lower-cased); empty ones are left out, those that are none raise.
    """
    rows, pairs = [], confusables.relation(spark, confusables_path)
    for n, name in enumerate(domains):
        if name:
            host = hosts.parse_host(name)
            if host is None:
                raise ValueError(f"{name} is not a host")
            shown = host[2].lower().rstrip(".")
            rows.append((n, shown, confusables.skeleton(shown, pairs), None if rows else pairs))
    return spark.createDataFrame(rows, "ord int, domain string, skeleton string, confusables map<string,string>")
