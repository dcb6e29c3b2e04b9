"""Guarded fetching over tables: address decisions per request, and redirects followed by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hosts, netaddr
from ..functions.addresses import absolute
from ..operators.urls import taken_apart
from ..policy import Policy
from ..sources.staging import cut

REDIRECTS = (301, 302, 303, 307, 308)
MOST_ADDRESSES = 16


def decide(requests: DataFrame, dns: DataFrame, networks: DataFrame, allow_hosts: tuple[str, ...] = ()) -> DataFrame:
    """(request_id, allowed, rule, addresses) of requests (request_id, host, port, endpoint) against ``dns`` (host, ord, family, digits).

    A host on the allow list passes, and so does an address in a network on it (``10.0.0.0/8``, ``::1``). A host that is an address
    by itself needs no answer. One denied address refuses the whole answer, unless it is the parent's own ``endpoint``
    (``digits:port``); ``rule`` is that of the first denied one. At most 16 addresses are handed on, in order. A host without an
    answer isn't allowed and has no rule.
    """
    literal = requests.select("host").distinct().withColumn("h", hosts.parsed_host(F.col("host"))).where("h.kind IN ('ipv4', 'ipv6')")
    literal = literal.select("host", F.lit(0).alias("ord"), F.when(F.col("h.kind") == "ipv4", 4).otherwise(6).alias("family"), "h.digits")
    dns = dns.join(literal, "host", "left_anti").select("host", "ord", "family", "digits").unionByName(literal)
    allowed_networks = tuple(x for x in allow_hosts if netaddr.is_network(x))
    known = dns.select("family", "digits").distinct().withColumn("address", F.concat_ws("/", F.col("family").cast("string"), "digits"))
    rules = netaddr.classify(known.withColumnRenamed("family", "of_family"), networks, "address", "of_family", "digits")
    answers = dns.withColumn("address", F.concat_ws("/", F.col("family").cast("string"), "digits")).join(rules, "address", "left")
    if allowed_networks:
        table = requests.sparkSession.createDataFrame(netaddr.network_rows([(x, "allowed") for x in allowed_networks]), netaddr.NETWORKS)
        good = netaddr.classify(known.withColumnRenamed("family", "of_family"), table, "address", "of_family", "digits").select("address", F.lit(True).alias("good"))
        answers = answers.join(good, "address", "left").withColumn("rule", F.when(F.col("good").isNull(), F.col("rule"))).drop("good")
    answers = answers.drop("address")
    met = requests.join(answers, "host", "left")
    exempt = F.coalesce(F.col("endpoint") == F.concat("digits", F.lit(":"), F.col("port").cast("string")), F.lit(False))
    passed = F.col("host").isin(*allow_hosts) if allow_hosts else F.lit(False)
    denied = F.col("rule").isNotNull() & ~exempt & ~passed
    out = met.groupBy("request_id").agg(F.bool_or(denied).alias("denied"), F.min_by("rule", F.when(denied, F.col("ord"))).alias("first"), F.array_sort(F.collect_list(F.when(F.col("digits").isNotNull(), F.struct("ord", "digits")))).alias("found"))
    allowed = ~F.col("denied") & (F.size("found") > 0)
    addresses = F.slice(F.transform("found", lambda x: x["digits"]), 1, MOST_ADDRESSES)
    return out.select("request_id", allowed.alias("allowed"), F.when(F.col("denied"), F.col("first")).alias("rule"), F.when(allowed, addresses).otherwise(F.array().cast("array<string>")).alias("addresses"))


def guarded(origin: str, policy: Policy) -> bool:
    """Whether the guard looks at requests of an origin: ``subresource`` always, ``server`` and ``cli`` inputs by ``guard_input_urls``."""
    scope = policy.ssrf.guard_input_urls
    return origin == "subresource" or scope == "always" or (origin == "server" and scope == "server")


def resolve(urls: DataFrame, dns: DataFrame | None, networks: DataFrame, policy: Policy) -> DataFrame:
    """(url, port, answers, is_name) of the distinct URLs (column ``url``): ``answers`` are (ord, digits, rule) in order, ``rule`` that of the first
    network that denies the address, null where the policy allows it or its host.

    Hosts are parsed and looked up once each. ``dns``: host (as it reads in ASCII), ord, family, digits. A host that is an address by itself
    needs no answer; of others ``is_name`` is true, and ``answers`` is null without one.
    """
    rows = urls.select("url").distinct().withColumn("p", taken_apart(F.col("url")))
    port = F.coalesce(F.expr("try_cast(p.port AS int)"), F.when(F.col("p.scheme") == "https", 443).otherwise(80))
    rows = cut(rows.select("url", F.col("p.host").alias("written"), port.alias("port")))
    named = cut(rows.select("written").distinct().withColumn("h", hosts.parsed_host(F.col("written"))).select("written", "h.*"))
    answers = named.where("kind IN ('ipv4', 'ipv6')").select("written", F.lit(0).alias("ord"), F.when(F.col("kind") == "ipv4", 4).otherwise(6).alias("of_family"), "digits")
    if dns is not None:
        found = named.where("kind = 'domain'").select("written", F.col("ascii").alias("host")).join(dns.select("host", "ord", F.col("family").alias("of_family"), "digits"), "host")
        answers = answers.unionByName(found.drop("host"))
    answers = cut(answers.withColumn("address", F.concat_ws("/", F.col("of_family").cast("string"), "digits")))
    known = answers.select("address", "of_family", "digits").distinct()
    met = answers.join(netaddr.classify(known, networks, "address", "of_family", "digits"), "address", "left")
    allowed = [x for x in policy.ssrf.allow_hosts if netaddr.is_network(x)]
    if allowed:
        table = urls.sparkSession.createDataFrame(netaddr.network_rows([(x, "allowed") for x in allowed]), netaddr.NETWORKS)
        good = netaddr.classify(known, table, "address", "of_family", "digits").select("address", F.lit(True).alias("good"))
        met = met.join(good, "address", "left").withColumn("rule", F.when(F.col("good").isNull(), F.col("rule")))
    passed = F.col("written").isin(*policy.ssrf.allow_hosts) if policy.ssrf.allow_hosts else F.lit(False)
    told = met.groupBy("written").agg(F.array_sort(F.collect_list(F.struct("ord", "digits", F.when(~passed, F.col("rule")).alias("rule")))).alias("answers"))
    kinds = named.select("written", (F.col("kind") == "domain").alias("is_name"))
    return cut(rows.join(kinds, "written", "left").join(told, "written", "left").select("url", "port", "answers", F.coalesce("is_name", F.lit(True)).alias("is_name")))


def reached(port: Column, answers: Column) -> Column:
    """The ``digits:port`` of the first answer."""
    return F.concat(F.get(answers, F.lit(0))["digits"], F.lit(":"), port.cast("string"))


def denial(port: Column, answers: Column, is_name: Column, endpoint: Column, has_dns: bool, policy: Policy) -> Column:
    """The rule of the first denied answer that isn't the parent's own ``endpoint``; ``unresolved`` for a host without an answer; else null."""
    own = lambda x: F.coalesce(F.concat(x["digits"], F.lit(":"), port.cast("string")) == endpoint, F.lit(False)) if policy.ssrf.same_origin_exemption else F.lit(False)
    bad = F.get(F.filter(answers, lambda x: x["rule"].isNotNull() & ~own(x)), F.lit(0))["rule"]
    return F.when(answers.isNull(), F.when(F.lit(has_dns) | ~is_name, "unresolved")).otherwise(bad)


def vet(requests: DataFrame, dns: DataFrame | None, networks: DataFrame, policy: Policy) -> DataFrame:
    """(url, endpoint, rule, reached) of the distinct requests (url, endpoint): the rule that denies it, else the ``digits:port`` it reaches.

    Without ``dns`` only addresses that stand in URLs are known, and other hosts pass. A host without an answer has the rule ``unresolved``.
    """
    rows = requests.select("url", "endpoint").distinct().join(resolve(requests, dns, networks, policy), "url")
    rule = denial(F.col("port"), F.col("answers"), F.col("is_name"), F.col("endpoint"), dns is not None, policy)
    return rows.select("url", "endpoint", rule.alias("rule"), F.when(rule.isNull(), reached(F.col("port"), F.col("answers"))).alias("reached"))


def follow(requests: DataFrame, responses: DataFrame, limit: int = 5, blocked: DataFrame | None = None) -> DataFrame:
    """(request_id, final_url, hops, outcome) of requests (request_id, url) against ``responses`` (url, status, location).

    Each hop is one join, whose narrow result is written once. A location may be relative. ``outcome``: fetched (200 to 299),
    http_error, no_response, bad_redirect (no location), bad_scheme (neither http nor https), too_many, or blocked where a hop
    leads to one of the URLs in ``blocked`` (url).
    """
    return trails(requests, responses, limit, blocked)[0]


def trails(requests: DataFrame, responses: DataFrame, limit: int = 5, blocked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What ``follow`` gives, and (request_id, hop, url) of every URL on the way, the first one included."""
    live = requests.select("request_id", F.col("url").alias("final_url"), F.lit(0).alias("hops"))
    answers = responses.select(F.col("url").alias("final_url"), "status", "location")
    refused = None if blocked is None else blocked.select(F.col("url").alias("final_url"), F.lit(True).alias("refused")).distinct()
    ended = passed = None
    for hop in range(limit + 1):
        met = live.join(answers, "final_url", "left")
        met = met.withColumn("refused", F.lit(None).cast("boolean")) if refused is None else met.join(refused, "final_url", "left")
        moved = F.coalesce(F.col("status").isin(*REDIRECTS), F.lit(False)) & F.col("refused").isNull()
        empty = F.coalesce(F.trim("location") == "", F.lit(True))
        target = absolute(F.when(moved & ~empty, F.col("location")), F.col("final_url"))
        met = cut(met.select("request_id", "final_url", "hops", "status", "refused", moved.alias("moved"), (moved & empty).alias("bad"), target.alias("target")))
        outcome = (F.when(F.col("refused"), "blocked").when(F.col("status").isNull(), "no_response").when(F.col("bad"), "bad_redirect").when(F.col("moved") & (F.col("hops") >= limit), "too_many")
                   .when(F.col("moved"), "bad_scheme").when(F.col("status").between(200, 299), "fetched").otherwise("http_error"))
        goes_on = F.col("moved") & F.col("target").isNotNull() & (F.col("hops") < limit)
        now, seen = met.where(~goes_on).select("request_id", "final_url", "hops", outcome.alias("outcome")), met.select("request_id", F.col("hops").alias("hop"), F.col("final_url").alias("url"))
        ended, passed = (now, seen) if ended is None else (ended.unionByName(now), passed.unionByName(seen))
        live = met.where(goes_on).select("request_id", F.col("target").alias("final_url"), (F.col("hops") + 1).alias("hops"))
        if hop == limit or live.isEmpty():
            break
    return ended, passed


def ways(urls: DataFrame, responses: DataFrame, policy: Policy) -> DataFrame:
    """(url, hops, final_url, outcome) of the distinct URLs: the URLs on the way in order, and where it ends by ``follow``.

    Of several responses (url, status, location) for a URL the least counts.
    """
    asked = urls.select(F.col("url").alias("request_id"), "url").distinct()
    answers = cut(responses.groupBy("url").agg(F.min(F.struct("status", "location")).alias("r")).select("url", "r.*"))
    ended, passed = trails(asked, answers, policy.fetch.redirect_limit)
    hops = passed.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("hop", "url"))).alias("hops"))
    return cut(hops.join(ended.select("request_id", "final_url", "outcome"), "request_id").select(F.col("request_id").alias("url"), F.transform("hops", lambda h: h["url"]).alias("hops"), "final_url", "outcome"))


def judge(requests: DataFrame, known: DataFrame, resolved: DataFrame, has_dns: bool, policy: Policy, origin: str) -> DataFrame:
    """(url, endpoint, final_url, hops, outcome, rule) of the distinct requests (url, endpoint) along their ``ways``.

    The first denied URL on a way is where it ends: ``blocked`` with its ``rule``, or ``unresolved``. ``resolved`` knows all URLs on all ways.
    ``endpoint`` is the parent's own address and port, which stay allowed.
    """
    steps = known.select("url", F.posexplode("hops").alias("hop", "at_url")).join(resolved.withColumnRenamed("url", "at_url"), "at_url")
    steps = steps.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("hop", "at_url", "port", "answers", "is_name"))).alias("steps"))
    rows = requests.select("url", "endpoint").distinct().join(known.select("url", "final_url", "outcome", (F.size("hops") - 1).alias("last")), "url").join(steps, "url")
    denied = F.transform("steps", lambda x: F.struct(x["hop"].alias("hop"), x["at_url"].alias("at_url"), denial(x["port"], x["answers"], x["is_name"], F.col("endpoint"), has_dns, policy).alias("rule")))
    counts = lambda x: x["rule"].isNotNull() & (F.lit(guarded(origin, policy)) | (x["rule"] == "unresolved"))
    rows = rows.withColumn("stop", F.get(F.filter(denied, counts), F.lit(0)))
    stopped, nowhere = F.col("stop").isNotNull(), F.col("stop.rule") == "unresolved"
    return rows.select(
        "url", "endpoint", F.when(stopped, F.col("stop.at_url")).otherwise(F.col("final_url")).alias("final_url"), F.when(stopped, F.col("stop.hop")).otherwise(F.col("last")).alias("hops"),
        F.when(nowhere, "unresolved").when(stopped, "blocked").otherwise(F.col("outcome")).alias("outcome"), F.when(~nowhere, F.col("stop.rule")).alias("rule"))


def fetched(requests: DataFrame, responses: DataFrame, dns: DataFrame | None, networks: DataFrame, policy: Policy, origin: str) -> DataFrame:
    """What ``judge`` gives for requests (url, endpoint): every URL on every way is resolved and classified once."""
    known = ways(requests, responses, policy)
    resolved = resolve(known.select(F.explode("hops").alias("url")), dns, networks, policy)
    return judge(requests, known, resolved, dns is not None, policy, origin)
