"""The sanitiser as one plan: inputs -> type -> scan or HTML rules -> status -> report rows and the run's summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import sniff
from ..operators import html, scanners
from ..operators.html import ACTION, REFERENCE
from ..policy import Policy
from ..sources.staging import small_batches

#: Statuses by bucket; all others are errors.
OK, REFUSED = ("sanitised", "clean"), ("refused", "ssrf_blocked", "budget_exceeded")


def bucket(status: Column) -> Column:
    return F.when(status.isin(*OK), "ok").when(status.isin(*REFUSED), "refused").otherwise("errored")


def typed(inputs: DataFrame) -> DataFrame:
    """The inputs with ``declared``, ``sniffed`` and ``effective`` types. Only ZIP archives leave the JVM, to tell office files."""
    both = F.struct(sniff.declared(F.col("declared_header"), F.col("name")).alias("declared"), sniff.sniffed(F.col("data")).alias("sniffed"))
    rows = inputs.withColumn("_types", F.explode(F.array(both)))  # a row each: the types are worked out once, not at each use
    folder = scanners.telling_folder(F.when(F.col("_types.sniffed") == "application/zip", F.col("data")))
    rows = rows.withColumn("declared", F.col("_types.declared")).withColumn("sniffed", F.coalesce(sniff.office_kind(folder), F.col("_types.sniffed"))).drop("_types")
    return rows.withColumn("effective", sniff.effective(F.col("sniffed"), F.col("declared")))


def process(inputs: DataFrame, policy: Policy, blocklist: DataFrame, protected: DataFrame, networks: DataFrame) -> DataFrame:
    """One report row per input (id, name, data binary, declared_header): status, bucket, sizes, types, actions, references, base, output.

    An input over the byte budget is ``budget_exceeded`` and isn't looked at. A file that could exhaust a reader, or that has
    active content the policy rejects, is ``refused`` and loses its bytes. HTML goes through the HTML rules, SVG as well (any
    finding there is active content). An allowed finding in CSS, TIFF or PDF is taken out of the bytes; all else passes unchanged. A contradiction of types is an action, not a refusal. Null
    data is empty. ids must be distinct. Sets the session's bound of batches for Python (see ``staging.small_batches``).
    """
    small_batches(inputs.sparkSession)
    small = F.octet_length("data") <= policy.budgets.max_input_bytes
    rows = typed(inputs.withColumn("data", F.coalesce("data", F.lit(b"")))).withColumn("within", small)
    reject = policy.subresources.active_content_rule == "reject"
    none = F.array().cast(f"array<{ACTION}>")
    place = lambda line, at: F.struct(line.cast("bigint").alias("line"), at.cast("bigint").alias("byte_offset"))
    mismatch = F.when(sniff.contradicted(F.col("sniffed"), F.col("declared")), F.array(F.struct(
        F.lit("sniff.mime_mismatch").alias("rule_id"), F.lit("sniff").alias("category"), place(F.lit(0), F.lit(0)).alias("location"),
        sniff.mismatch_text(F.col("sniffed"), F.col("declared")).alias("original"), F.lit("rewrite").alias("action"), F.lit(None).cast("string").alias("replacement")))).otherwise(none)
    rows = rows.withColumn("mismatch", mismatch)
    is_markup = F.col("within") & F.coalesce(F.col("effective").isin("text/html", "image/svg+xml"), F.lit(False))
    both = html.sanitize(rows, policy, blocklist, protected, networks, is_markup).withColumnRenamed("actions", "found").withColumn("markup", is_markup)
    svg = F.col("markup") & (F.col("effective") == "image/svg+xml")
    act = F.lit("refuse" if reject else "allow")
    as_active = F.transform(F.filter("found", lambda a: a["category"] == "xss"), lambda a: a.withField("action", act))
    both = both.withColumn("found", F.when(svg, as_active).otherwise(F.col("found")))
    both = both.withColumn("refused", F.when(svg & (F.size("found") > 0), F.lit(reject)).otherwise(F.col("refused")))
    both = both.withColumn("output", F.when(svg & (F.size("found") == 0) & ~F.col("refused"), F.col("data")).otherwise(F.col("output")))
    scanned = F.col("within") & ~F.col("markup")
    both = both.withColumn("findings", scanners.scan(F.when(scanned, F.col("data")), F.col("effective"), policy))

    def finding(f: Column) -> Column:
        cut = F.make_valid_utf8(F.substring(F.col("data"), f["offset"].cast("int") + 1, F.lit(200)).cast("string"))
        return F.struct(f["rule"].alias("rule_id"), f["category"].alias("category"), place(f["line"], f["offset"]).alias("location"), cut.alias("original"),
                        F.when(f["category"] == "dos", "refuse").otherwise(act).alias("action"), F.lit(None).cast("string").alias("replacement"))

    both = both.withColumn("refused", F.col("refused") | F.exists("findings", lambda f: (f["category"] == "dos") | F.lit(reject)))
    both = both.withColumn("found", F.concat("found", F.transform("findings", finding)))
    kept = F.when(scanned & ~F.col("refused"), F.col("data"))
    rewritten = kept if reject else scanners.rewritten(kept, F.col("effective"), scanned & ~F.col("refused") & (F.size("findings") > 0))
    both = both.withColumn("output", F.when(F.col("markup"), F.col("output")).otherwise(rewritten)).drop("findings", "markup")
    actions = F.when(F.col("within"), F.concat("mismatch", "found")).otherwise(none)
    both = both.withColumn("actions", actions)
    status = F.when(~F.col("within"), "budget_exceeded").when(F.col("refused"), "refused").when(F.size("actions") == 0, "clean").otherwise("sanitised")
    return both.select("id", "name", status.alias("status"), bucket(status).alias("bucket"), F.octet_length("data").cast("bigint").alias("bytes_in"),
                       F.coalesce(F.octet_length("output"), F.lit(0)).cast("bigint").alias("bytes_out"), F.col("declared").alias("declared_mime"), F.col("sniffed").alias("sniffed_mime"),
                       "actions", "references", "base", "output")


def run_summary(reports: DataFrame, subreports: DataFrame | None = None) -> DataFrame:
    """One row: inputs by bucket, those blocked as internal, and the same of sub-resources (url-level rows with ``status``)."""
    top = reports.agg(
        F.count("*").alias("inputs_total"), F.count_if(F.col("bucket") == "ok").alias("inputs_ok"), F.count_if(F.col("bucket") == "refused").alias("inputs_refused"),
        F.count_if(F.col("bucket") == "errored").alias("inputs_errored"), F.count_if(F.col("status") == "ssrf_blocked").alias("top_blocked"))
    if subreports is None:
        return top.select("inputs_total", "inputs_ok", "inputs_refused", "inputs_errored", F.lit(0).cast("bigint").alias("subresources_fetched"),
                          F.lit(0).cast("bigint").alias("subresources_refused"), F.col("top_blocked").alias("ssrf_blocked"))
    state = bucket(F.col("status"))
    sub = subreports.agg(F.count_if(state == "ok").alias("subresources_fetched"), F.count_if(state == "refused").alias("subresources_refused"), F.count_if(F.col("status") == "ssrf_blocked").alias("sub_blocked"))
    return top.join(F.broadcast(sub)).select("inputs_total", "inputs_ok", "inputs_refused", "inputs_errored", "subresources_fetched", "subresources_refused", (F.col("top_blocked") + F.col("sub_blocked")).alias("ssrf_blocked"))  # one row each


def observed(reports: DataFrame) -> tuple[DataFrame, Observation]:
    """The reports, and an observation whose ``get`` is the run's summary once they have been written: no second pass over them."""
    seen = Observation("run")
    state, blocked = F.col("bucket"), F.count_if(F.col("status") == "ssrf_blocked")
    sub = lambda wanted: F.coalesce(F.sum(F.when(F.col("subresources").isNotNull(), F.size(F.filter("subresources", wanted)))), F.lit(0)).cast("bigint") if "subresources" in reports.columns else F.lit(0).cast("bigint")
    rows = reports.observe(
        seen, F.count("*").alias("inputs_total"), F.count_if(state == "ok").alias("inputs_ok"), F.count_if(state == "refused").alias("inputs_refused"), F.count_if(state == "errored").alias("inputs_errored"),
        sub(lambda s: bucket(s["status"]) == "ok").alias("subresources_fetched"), sub(lambda s: bucket(s["status"]) == "refused").alias("subresources_refused"), (blocked + sub(lambda s: s["status"] == "ssrf_blocked")).alias("ssrf_blocked"))
    return rows, seen


def write_reports(reports: DataFrame, path: str) -> tuple[dict[str, int], int]:
    """Writes the reports as Parquet in one query; the run's summary as observed on the way, and its exit code: 1 if an input was refused."""
    rows, seen = observed(reports)
    rows.write.mode("overwrite").parquet(path)
    summary = {k: v or 0 for k, v in seen.get.items()}
    return summary, int(summary["inputs_refused"] > 0)


def exit_code(reports: DataFrame) -> DataFrame:
    return reports.agg(F.coalesce(F.max((F.col("bucket") == "refused").cast("int")), F.lit(0)).alias("exit_code"))


def report_json(reports: DataFrame) -> DataFrame:
    """(id, report): each report row as JSON; absent optional values are left out, nulls inside actions are kept as null.

    Rows of ``subresources.sanitise_whole`` have their sub-resources in it.
    """
    action = F.transform("actions", lambda a: F.to_json(F.struct(a["rule_id"].alias("rule_id"), a["category"].alias("category"), a["location"].alias("location"), a["original"].alias("original"),
                                                                 a["action"].alias("action"), a["replacement"].alias("replacement")), {"ignoreNullFields": "false"}))
    head = F.to_json(F.struct("id", "name", "status", "bytes_in", "bytes_out", "declared_mime", "sniffed_mime"), {"ignoreNullFields": "false"})
    more = F.lit("")
    if "subresources" in reports.columns:
        more = F.coalesce(F.concat(F.lit(',"subresources":'), F.to_json("subresources", {"ignoreNullFields": "false"})), F.lit(""))
    return reports.withColumn("_h", head).withColumn("_a", action).select("id", F.concat(F.expr("left(_h, length(_h) - 1)"), F.lit(',"actions":['), F.array_join("_a", ","), F.lit("]"), more, F.lit("}")).alias("report"))


#: HTTP codes of statuses that aren't 200.
HTTP_CODES = {"budget_exceeded": 413, "ssrf_blocked": 403, "fetch_error": 502, "unsupported_scheme": 400, "malformed_url": 400, "io_error": 500, "internal_error": 500, "skipped_symlink": 500}


def responses(reports: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """(id, http_code, body): what a server would answer for each report: contents in base64, those of ``assets`` (id, name, output) by path,
    and the status as ``error`` where the code isn't 200."""
    codes = F.create_map(*[F.lit(x) for kv in HTTP_CODES.items() for x in kv])
    code = F.coalesce(codes[F.col("status")], F.lit(200))
    if assets is not None:
        own = assets.select(F.col("id").alias("_of"), F.struct(F.col("name").alias("path"), F.base64("output").alias("content")).alias("a")).groupBy("_of").agg(F.array_sort(F.collect_list("a")).alias("assets"))
        reports = reports.join(own, F.col("id") == F.col("_of"), "left")
    more = [F.col("assets")] if assets is not None else []
    body = F.to_json(F.struct("status", "bytes_in", "bytes_out", F.base64("output").alias("content"), F.transform("actions", lambda a: a["rule_id"]).alias("rules"), *more, F.when(code != 200, F.col("status")).alias("error")))
    return reports.select("id", code.alias("http_code"), body.alias("body"))
