"""Sub-resources of a page over a table of responses: absolute URLs, first occurrences, the guard, request and byte budgets, outcomes.

Nothing is fetched: ``responses`` stands for the network. References are classified and guarded as distinct URLs before any body is
read, and only bodies that were asked for are. Only the byte budget needs order with feedback (a response that doesn't fit counts
nothing); it is one pass over each page's references in order, with one number as its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sniff
from ..functions.addresses import absolute
from ..operators.html import ACTION, rewrite_references
from ..operators.urls import classify_urls
from ..policy import Policy
from ..sources.inputs import safe_name
from ..sources.staging import cut, stage
from . import guard, pipeline

KIND_OF = {"text/css": "css", "text/javascript": "js", "image/jpeg": "image", "image/png": "image", "image/gif": "image", "image/webp": "image", "image/svg+xml": "image", "image/tiff": "image"}
#: Labels of URLs that are refused before any request, and the types that references claim for a body without one.
UNASKED = ("blocked", "homograph", "malformed", "userinfo")
CLAIMED = {"css": "text/css", "js": "text/javascript"}


def resolved(reports: DataFrame) -> DataFrame:
    """(id, n, url, raw, kind): the references of reports (id, page_url, base, references) as absolute URLs, the first of each URL."""
    rows = reports.select("id", F.when(F.col("base").isNotNull(), F.coalesce(absolute(F.col("base"), F.col("page_url")), F.col("base"))).otherwise(F.col("page_url")).alias("document"), F.posexplode("references").alias("n", "r"))
    rows = rows.select("id", "n", F.col("r.raw").alias("raw"), F.col("r.kind").alias("kind"), absolute(F.col("r.raw"), F.col("document")).alias("url")).where(F.col("url").isNotNull())
    first = F.row_number().over(Window.partitionBy("id", "url").orderBy("n"))
    return rows.withColumn("first", first).where("first = 1").drop("first")


def slots(reports: DataFrame, max_requests: int, refused: DataFrame | None = None) -> DataFrame:
    """(id, slot, url, raw, kind, refusal, over): each page's references, the first of each URL, numbered from 0.

    ``reports`` has id, page_url, base and references. ``refused`` (url, label) names URLs that are refused before any request;
    these take none of the request budget. ``over`` tells the references beyond the budget.
    """
    return numbered(resolved(reports), max_requests, refused)


def numbered(rows: DataFrame, max_requests: int, refused: DataFrame | None = None) -> DataFrame:
    """``resolved`` references with their slot and whether the request budget holds."""
    rows = rows.join(refused.select("url", F.col("label").alias("refusal")), "url", "left") if refused is not None else rows.withColumn("refusal", F.lit(None).cast("string"))
    in_order = Window.partitionBy("id").orderBy("n")
    asked = F.col("refusal").isNull().cast("int")
    before = F.coalesce(F.sum(asked).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("id", (F.row_number().over(in_order) - 1).alias("slot"), "url", "raw", "kind", "refusal", (F.col("refusal").isNull() & (before >= max_requests)).alias("over"))


def one_each(responses: DataFrame) -> DataFrame:
    """One response for each URL: of several the one of least status, location and hash of the body."""
    rest = [c for c in responses.columns if c != "url"]
    order = F.struct("status", *[F.col(c) for c in ("location", "content_type", "failure") if c in rest], F.sha2("body", 256))
    return responses.groupBy("url").agg(F.min_by(F.struct(*rest), order).alias("r")).select("url", "r.*")


def claim(content_type: Column, url: Column, kind: Column) -> Column:
    """What a reference claims for a body: the type of its kind where neither header nor name declares one, else nothing (empty)."""
    types = F.create_map(*[F.lit(x) for kv in CLAIMED.items() for x in kv])
    return F.when(sniff.declared(content_type, url).isNull(), F.coalesce(types[kind], F.lit(""))).otherwise("")


def bodies(responses: DataFrame, policy: Policy, blocklist: DataFrame, protected: DataFrame, networks: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(url, claimed, handled, actions, output) of responses with a body: every body goes the way of an input, with the same rules.

    ``asked`` (url, claimed): the bodies that are wanted, and the type to take one for that declares none; others aren't looked at.
    """
    found = responses.where(F.col("body").isNotNull())
    if asked is not None:
        found = found.join(asked.select("url", "claimed").distinct(), "url")
    else:
        found = found.withColumn("claimed", F.lit(""))
    name = F.concat_ws("\n", "claimed", "url")
    header = F.when(F.col("claimed") != "", F.col("claimed")).otherwise(F.col("content_type"))
    inputs = found.select(name.alias("id"), F.col("url").alias("name"), F.col("body").alias("data"), header.alias("declared_header"), "url", "claimed")
    known = inputs.select("id", "url", "claimed").dropDuplicates(["id"])
    done = pipeline.process(inputs.drop("url", "claimed").dropDuplicates(["id"]), policy, blocklist, protected, networks)
    return done.select("id", F.col("status").alias("handled"), "actions", "output").join(known, "id").select("url", "claimed", "handled", "actions", "output")


SPENT = "id string, slot int, state string, length long"


def _spend(batches: Iterator[pa.RecordBatch], total: int, most: int, count_refused: bool) -> Iterator[pa.RecordBatch]:
    """References (SPENT) in order of page and slot -> the same with the states that the byte budget leaves.

    A reference that is ``fetched``, in whatever state it ends, must fit into what remains of the page's total, and into ``most``.
    """
    page, used = None, 0
    for batch in batches:
        states, lengths = batch.column(2).to_pylist(), np.asarray(batch.column(3)).tolist()
        for k, (own, state, length) in enumerate(zip(batch.column(0).to_pylist(), states, lengths, strict=True)):
            if own != page:
                page, used = own, 0
            kept = state in ("clean", "sanitised")
            if count_refused and state != "budget_exceeded" and used >= total:
                states[k] = "budget_exceeded"
            elif (kept or state == "refused") and length > 0:
                if length > min(total - used, most):
                    states[k] = "budget_exceeded"
                elif kept or count_refused:
                    used += length
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(states, pa.string()), batch.column(3)], ["id", "slot", "state", "length"])


def outcomes(rows: DataFrame, responses: DataFrame, policy: Policy, handled: DataFrame | None = None, ways: DataFrame | None = None, count_refused: bool = False) -> DataFrame:
    """(id, slot, url, raw, kind, status, rule, bytes, asset, final_url, claimed): what became of each reference in ``slots``.

    ``responses``: url, status, content_type, body, failure, one for each URL. ``handled`` is what ``bodies`` makes of them: a refused
    body is ``refused``, one that is changed ``sanitised``; an asset's content is its output there. ``ways`` (url, endpoint, final_url,
    outcome) tells where a request led (see ``guard.fetched``); ``rows`` then have ``endpoint``. A body over what remains of the
    page's bytes is ``budget_exceeded`` and uses none of it; with ``count_refused`` every body that was fetched uses it, refused ones too, and with
    none left nothing is asked for. A mismatch of types, a type outside the policy's and a refused URL are ``refused``; a way to a denied
    address is ``ssrf_blocked``; a missing response, a failure or a status outside 200 to 299 is ``fetch_error``.
    """
    rules = policy.subresources
    narrow = responses.select(
        F.col("url").alias("final_url"), F.col("status").alias("http"), "failure", F.col("content_type").alias("header"), sniff.of_header(F.col("content_type")).alias("declared"), sniff.sniffed(F.col("body")).alias("sniffed"),
        F.coalesce(F.octet_length("body"), F.lit(0)).cast("bigint").alias("length"))
    if ways is None:
        met = rows.withColumn("final_url", F.col("url")).withColumn("outcome", F.lit("fetched"))
    else:
        same = (F.col("r.url") == F.col("w.url")) & F.col("r.endpoint").eqNullSafe(F.col("w.endpoint"))
        met = rows.alias("r").join(ways.alias("w"), same, "left").select("r.*", "w.final_url", "w.outcome")
    met = met.join(narrow, "final_url", "left").withColumn("claimed", claim(F.col("header"), F.col("final_url"), F.col("kind")))
    if handled is not None:
        of = handled.select(F.col("url").alias("final_url"), "claimed", "handled")
        met = met.join(of, ["final_url", "claimed"], "left") if ways is not None else met.join(of.drop("claimed"), "final_url", "left")
    else:
        met = met.withColumn("handled", F.lit("clean"))
    declared, sniffed = F.col("declared"), F.col("sniffed")
    kinds = F.create_map(*[F.lit(x) for kv in KIND_OF.items() for x in kv])
    own = F.coalesce(kinds[sniff.effective(sniffed, declared)], F.when(sniff.effective(sniffed, declared).isNull(), F.col("kind")))
    contradicted = sniff.contradicted(sniffed, declared if ways is None else F.coalesce(sniff.declared(F.col("header"), F.col("final_url")), F.nullif("claimed", F.lit(""))))
    mismatch = contradicted & F.lit(rules.sniff_rule == "reject")
    ok_type = F.coalesce(own.isin(*rules.types), F.lit(False))
    state = (F.when(F.col("refusal").isNotNull(), "refused").when(F.col("over"), "budget_exceeded").when((F.col("failure") == "ssrf") | (F.col("outcome") == "blocked"), "ssrf_blocked")
             .when((F.col("outcome") != "fetched") | F.col("http").isNull() | F.col("failure").isNotNull() | ~F.col("http").between(200, 299), "fetch_error").when(mismatch | ~ok_type, "refused")
             .otherwise(F.coalesce("handled", F.lit("clean"))))
    length = F.when(F.col("refusal").isNull() | F.lit(not count_refused), F.coalesce("length", F.lit(0).cast("bigint"))).otherwise(0)
    met = met.select("id", "slot", "url", "raw", "kind", "final_url", "claimed", "refusal", state.alias("state"), length.cast("bigint").alias("length"), sniff_extension(sniffed, declared, own).alias("ext"))
    met = cut(met)
    asked = met.where(F.col("refusal").isNull() | F.lit(not count_refused)).select(F.col("id").cast("string").alias("id"), "slot", "state", "length")
    most = policy.fetch.max_response_bytes if count_refused else 1 << 62
    spent = asked.repartition("id").sortWithinPartitions("id", "slot").mapInArrow(lambda b: _spend(b, rules.max_total_bytes, most, count_refused), SPENT)
    spent = spent.select(F.col("id").alias("_of"), F.col("slot").alias("_slot"), F.col("state").alias("left_state"))
    done = met.join(spent, (F.col("id").cast("string") == F.col("_of")) & (F.col("slot") == F.col("_slot")), "left")
    status = F.coalesce("left_state", "state")
    passed = status.isin("clean", "sanitised")
    rule = F.when(status == "refused", "subresource.refused").when(status == "budget_exceeded", "subresource.budget_exceeded").when(status == "ssrf_blocked", "subresource.ssrf_blocked")
    asset = F.when(passed, F.concat(F.lit("asset-"), F.col("slot"), F.lit("."), F.col("ext")))
    return done.select("id", "slot", "url", "raw", "kind", status.alias("status"), rule.alias("rule"), F.when(passed, F.col("length")).otherwise(0).alias("bytes"), asset.alias("asset"), "final_url", "claimed")


def with_columns(responses: DataFrame) -> DataFrame:
    """Responses with a null ``location`` and ``failure`` where the table has none."""
    for name in ("location", "failure"):
        if name not in responses.columns:
            responses = responses.withColumn(name, F.lit(None).cast("string"))
    return responses


def sanitise_whole(inputs: DataFrame, responses: DataFrame, policy: Policy, blocklist: DataFrame, protected: DataFrame, networks: DataFrame,
                   refused: DataFrame | None = None, dns: DataFrame | None = None, folders: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pages with all they refer to: (reports, assets).

    ``inputs`` are those of ``pipeline.process``; the name is the page's URL. Its references are refused by their label (block-listed,
    look-alike, malformed, with credentials), or because ``refused`` (url, label) names them; the others are guarded at every hop
    against ``networks`` and ``dns`` (see ``guard.vet``; the page's own endpoint is exempt), looked up in ``responses``, the bodies that
    were reached sanitised, and the page rewritten to what was kept. A report has ``subresources`` (slot, url, status, rule, bytes) and its
    actions go on with one for each reference that was refused; assets are (id, name, output), with ``folders`` named in a folder of
    the page's (``<id>-<name>.assets/asset-<slot>``). Pages that are refused ask for nothing.
    """
    reports = stage(pipeline.process(inputs, policy, blocklist, protected, networks))
    asking = reports.where(F.col("output").isNotNull())
    found = cut(resolved(asking.select("id", F.col("name").alias("page_url"), "base", "references")))
    labels = classify_urls(found.select("url"), blocklist, protected, networks).where(F.col("label").isin(*UNASKED)).select("url", "label")
    if refused is not None:
        labels = labels.unionByName(refused.select("url", "label")).groupBy("url").agg(F.min("label").alias("label"))
    labels = cut(labels)
    asked = cut(numbered(found, policy.subresources.max_requests, labels))
    responses = with_columns(responses)
    known = guard.ways(asked.where("refusal IS NULL AND NOT over"), responses.select("url", "status", "location"), policy)
    pages = asking.select("id", F.col("name").alias("url")).where(F.lower("url").rlike("^https?://"))
    resolved_urls = guard.resolve(known.select(F.explode("hops").alias("url")).unionByName(pages.select("url")), dns, networks, policy)
    own = pages.join(resolved_urls, "url").select("id", guard.reached(F.col("port"), F.col("answers")).alias("endpoint"))
    asked = cut(asked.join(own, "id", "left"))
    ways = cut(guard.judge(asked.where("refusal IS NULL AND NOT over"), known, resolved_urls, dns is not None, policy, "subresource"))
    reached = asked.join(ways.where("outcome = 'fetched'").withColumnRenamed("endpoint", "of"), "url").where(F.col("endpoint").eqNullSafe(F.col("of"))).select(F.col("final_url").alias("url"), "kind").distinct()
    answers = stage(one_each(responses.join(reached.select("url").distinct(), "url", "left_semi")))
    types = answers.select("url", "content_type").join(reached, "url").select("url", claim(F.col("content_type"), F.col("url"), F.col("kind")).alias("claimed"))
    handled = stage(bodies(answers, policy, blocklist, protected, networks, types))
    found = cut(outcomes(asked, answers, policy, handled, ways, count_refused=True))
    if folders:
        found = found.join(reports.select("id", F.concat(safe_name(F.col("id"), F.col("name")), F.lit(".assets/")).alias("folder")), "id").withColumn("asset", F.concat("folder", "asset")).drop("folder")
    changed = rewrites(found, policy) if policy.subresources.rewrite_refs else rewrites(found, policy).where(F.lit(False))
    pages = reports.where(F.col("output").isNotNull()).select("id", F.col("output").alias("data")).join(changed, "id")
    outputs = rewrite_references(pages).select(F.col("id").alias("_of"), F.col("output").alias("rewritten"))
    line = F.struct("slot", "url", "status", "rule", "bytes")
    action = F.struct(F.col("rule").alias("rule_id"), F.lit("subresource").alias("category"), F.struct(F.lit(0).cast("bigint").alias("line"), F.lit(0).cast("bigint").alias("byte_offset")).alias("location"),
                      F.col("raw").alias("original"), F.lit(policy.subresources.action_refused).alias("action"), F.lit(policy.urls.placeholder_url).alias("replacement"))
    per_page = found.groupBy(F.col("id").alias("_id")).agg(
        F.array_sort(F.collect_list(line)).alias("subresources"), F.transform(F.array_sort(F.collect_list(F.when(F.col("rule").isNotNull(), F.struct("slot", action.alias("a"))))), lambda x: x["a"]).alias("more"))
    joined = reports.join(per_page, F.col("id") == F.col("_id"), "left").join(outputs, F.col("id") == F.col("_of"), "left")
    more = F.coalesce("more", F.array().cast(f"array<{ACTION}>")).cast(f"array<{ACTION}>")
    output = F.coalesce("rewritten", "output")
    status = F.when((F.col("status") == "clean") & (F.size(more) > 0), "sanitised").otherwise(F.col("status"))
    whole = joined.select("id", "name", status.alias("status"), "bucket", "bytes_in", F.coalesce(F.octet_length(output), F.lit(0)).cast("bigint").alias("bytes_out"), "declared_mime", "sniffed_mime",
                          F.concat("actions", more).alias("actions"), "references", "base", output.alias("output"), "subresources")
    kept = found.where(F.col("asset").isNotNull()).select("id", F.col("asset").alias("asset_name"), F.col("final_url").alias("url"), "claimed")
    return whole, kept.join(handled.select("url", "claimed", "output"), ["url", "claimed"]).select("id", F.col("asset_name").alias("name"), "output")


def sniff_extension(sniffed: Column, declared: Column, kind: Column) -> Column:
    by_type = F.create_map(*[F.lit(x) for kv in sniff.EXTENSION_OF.items() for x in kv])
    return F.coalesce(by_type[sniff.effective(sniffed, declared)], F.when(kind == "css", "css").when(kind == "js", "js").otherwise("bin"))


def rewrites(found: DataFrame, policy: Policy) -> DataFrame:
    """(id, rewrites): a map from a reference as written to its asset, or to the placeholder where it was refused; failures stay as they are."""
    refused = F.col("rule").isNotNull() & F.lit(policy.subresources.action_refused != "allow")
    target = F.when(F.col("asset").isNotNull(), F.col("asset")).when(refused, F.lit(policy.urls.placeholder_url))
    return found.withColumn("to", target).where(F.col("to").isNotNull()).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("raw", "to")))).alias("rewrites"))
