"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Only DataFrame functions are used. The corpus is read once into a narrow table (id, source, size, order); all that follows
works on that table and on one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column_name, cut, join_lookup, word_count

#: Slices of a source's seeded order. Only the slice in which a step of the filling ends is sorted row by row.
SLICES = 4096


def water_fill(sources: DataFrame, total: int, max_epochs: float) -> tuple[float, int]:
    """The water level and the number of rounds. ``sources`` has ``size`` and ``weight`` per source.

    A source gets ``min(level * weight, max_epochs * size)``. Each round clamps the sources above their cap and shares
    what is left among the others by weight; rounds end when none is newly clamped. The driver sees four sums a round.
    """
    level, clamped, rounds = 0.0, -1, 0
    cap = F.col("size") * F.lit(float(max_epochs))
    while True:
        over = F.lit(level) * F.col("weight") > cap
        row = sources.agg(
            F.count_if(over).alias("n"),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("free"),
        ).first()
        if row["n"] == clamped or row["free"] <= 0:
            return level, rounds
        clamped, rounds = row["n"], rounds + 1
        level = max(0.0, float(total) - row["fixed"]) / row["free"]


def mix(docs: DataFrame, weights: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        max_epochs: float = 3.0, seed: int = 17, cycle: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """One row per document: id, source, size (words), source_size, target (of its source) and repeats (0 to max_epochs, whole).

    Sources share the corpus' total size by weight. ``weights`` holds (source, weight); of a source given twice the weights add
    up, one that isn't given has weight 0. Without ``weights`` the sources, in code point order with null last, take ``cycle`` in
    turn. No source's target exceeds ``max_epochs`` times its size. Each document is taken floor(epochs) times; the fractional
    rest of a source's target is filled with whole documents in a seeded order that depends on id and text alone, so that reruns
    and other partitionings agree. A document that doesn't fit is passed over and later ones that fit are taken, until the rest
    is under half a percent of the target or no document fits; then one that is too large is taken if that comes nearer.

    Null texts have size 0 and, like empty ones, add nothing. Very long texts are only counted, in the JVM. A null source is a
    source of its own. Repeated rows are copies with one place in the order (ties): all of them are taken once more, or none. An
    empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    narrow, plan, n_sources = _plan(docs, weights, id_col, text_col, source_col, max_epochs, seed, cycle)
    rows = join_lookup(narrow, plan, "source", n_sources, F.col("order"))
    extra = _extra(F.col("slice"), F.col("order"), F.col("size"), F.col("fill"))
    return rows.select("id", "source", "size", "source_size", "target", (F.col("whole") + extra).cast("long").alias("repeats"))


def repeat_documents(docs: DataFrame, weights: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                     max_epochs: float = 3.0, seed: int = 17, cycle: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, with all their columns. No text is shuffled.

    Nulls, empty and very long texts, ties, repeated rows and empty tables are handled as in ``mix``; columns keep their names,
    whatever these are.
    """
    _, plan, n_sources = _plan(docs, weights, id_col, text_col, source_col, max_epochs, seed, cycle)
    own = {c: column_name(docs, f"_{c}") for c in ("source", "order", "size", "whole", "fill", "n")}
    lean = plan.select(*[F.col(c).alias(own[c]) for c in ("source", "whole", "fill")])
    rows = docs.withColumn(own["source"], docs[source_col].cast("string")).withColumn(own["order"], _order(docs, id_col, text_col, seed))
    rows = rows.withColumn(own["size"], word_count(docs[text_col]))  # below the join: counted once for each row
    rows = join_lookup(rows, lean, own["source"], n_sources, F.col(own["order"]))
    order = F.col(own["order"])
    times = F.col(own["whole"]).cast("int") + _extra(_slice(order), order, F.col(own["size"]), F.col(own["fill"]))
    return rows.withColumn(own["n"], F.explode(F.array_repeat(F.lit(1), times))).select(*[F.col(c) for c in docs.columns])


def _order(docs: DataFrame, id_col: str, text_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), docs[id_col], docs[text_col])


def _slice(order: Column) -> Column:
    return F.pmod(F.shiftright(order, 40), F.lit(SLICES))


def _extra(own_slice: Column, order: Column, size: Column, fill: Column) -> Column:
    """1 for a document that some step of the filling takes: it stands between the step's places and isn't larger than its limit."""
    def taken(step: Column) -> Column:
        place = F.struct(own_slice.alias("slice"), order.alias("order"))
        return (size > 0) & (place > step["after"]) & (place < step["before"]) & (size <= step["limit"])

    return F.coalesce(F.exists(fill, taken), F.lit(False)).cast("int")


PLACE = "struct<slice:bigint,order:bigint>"
STEP = f"struct<after:{PLACE},before:{PLACE},limit:double>"


def _place(own_slice: Column, order: Column) -> Column:
    return F.struct(own_slice.cast("bigint").alias("slice"), order.cast("bigint").alias("order")).cast(PLACE)


def _fill(narrow: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """(source, fill) for the sources of ``plan`` (source, target, rest): steps of an in-order filling of the rest.

    A step takes the documents after the last step's end that fit by themselves, up to the first that doesn't fit with those
    before it; that one is passed over. Each step reads the narrow table and one row per source; the slice sums lead to the
    slice in which a step ends, and only that slice is looked at document by document, copies added up before.
    """
    end = _place(F.lit(SLICES), F.lit(0))
    state = plan.select("source", "target", "rest", _place(F.lit(-1), F.lit(0)).alias("after"), F.array().cast(f"array<{STEP}>").alias("fill"))
    open_sources = (F.col("rest") >= 1) & (F.col("rest") > F.col("target") / 200) & F.col("after").isNotNull()
    while not state.where(open_sources).isEmpty():
        lean = state.where(open_sources).select("source", "rest", "after")
        fits = (F.col("size") > 0) & (F.col("size") <= F.col("rest")) & (_place(F.col("slice"), F.col("order")) > F.col("after"))
        rows = join_lookup(narrow, lean, "source", n_sources, F.col("order"), "inner").where(fits)
        sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("sum"), F.first("rest").alias("rest"))
        so_far = Window.partitionBy("source").orderBy("slice")
        sums = sums.withColumn("ends", F.sum("sum").over(so_far))
        full = cut(sums.groupBy("source").agg(F.max("ends").alias("all"), F.min(F.when(F.col("ends") > F.col("rest"), F.struct("slice", (F.col("ends") - F.col("sum")).alias("begin")))).alias("last")))
        at = full.where(F.col("last").isNotNull()).select("source", F.col("last.slice").alias("last_slice"), F.col("last.begin").alias("begin"))
        edge = join_lookup(rows, at, "source", n_sources, F.col("order"), "inner").where(F.col("slice") == F.col("last_slice"))
        edge = edge.groupBy("source", "slice", "order").agg(F.sum("size").alias("sum"), F.first("rest").alias("rest"), F.first("begin").alias("begin"))
        edge = edge.withColumn("ends", F.col("begin") + F.sum("sum").over(Window.partitionBy("source").orderBy("order")))
        edge = edge.groupBy("source").agg(F.min(F.when(F.col("ends") > F.col("rest"), F.struct("slice", "order", (F.col("ends") - F.col("sum")).alias("taken")))).alias("stop"))
        ends = full.select(F.col("source").alias("_of"), "all").join(edge.select(F.col("source").alias("_at"), "stop"), F.col("_of").eqNullSafe(F.col("_at")), "left").drop("_at")
        state = state.join(ends, state["source"].eqNullSafe(ends["_of"]), "left").drop("_of")
        stop = _place(F.col("stop.slice"), F.col("stop.order"))
        step = F.struct("after", F.when(F.col("stop").isNull(), end).otherwise(stop).alias("before"), F.col("rest").alias("limit")).cast(STEP)
        went = F.col("all").isNotNull()
        state = cut(state.select(
            "source", "target", (F.col("rest") - F.when(F.col("stop").isNotNull(), F.col("stop.taken")).otherwise(F.coalesce("all", F.lit(0)))).alias("rest"),
            F.when(open_sources & F.col("stop").isNotNull(), stop).alias("after"), F.when(went, F.concat("fill", F.array(step))).otherwise(F.col("fill")).alias("fill")))
    lean = state.where("rest >= 0.5").select("source", "rest", "fill")
    rows = join_lookup(narrow, lean, "source", n_sources, F.col("order"), "inner")
    left = (F.col("size") > F.col("rest")) & (F.col("size") < 2 * F.col("rest")) & (_extra(F.col("slice"), F.col("order"), F.col("size"), F.col("fill")) == 0)
    copies = rows.where(left).groupBy("source", "slice", "order", "size").agg(F.count("*").alias("n")).where("n = 1")
    over = copies.groupBy(F.col("source").alias("_of")).agg(F.min(F.struct("size", "slice", "order")).alias("one"))
    state = state.join(over, state["source"].eqNullSafe(over["_of"]), "left")
    one = F.struct(_place(F.col("one.slice"), F.col("one.order") - 1).alias("after"), _place(F.col("one.slice"), F.col("one.order") + 1).alias("before"), F.col("one.size").cast("double").alias("limit")).cast(STEP)
    return state.select("source", F.when(F.col("one").isNotNull(), F.concat("fill", F.array(one))).otherwise(F.col("fill")).alias("fill"))


def _plan(docs: DataFrame, weights: DataFrame | None, id_col: str, text_col: str, source_col: str, max_epochs: float, seed: int,
          cycle: tuple[float, ...]) -> tuple[DataFrame, DataFrame, int]:
    """(id, source, size, order, slice) of each document; per source its size, target, whole repetitions and the steps that fill
    the rest; the number of sources."""
    narrow = cut(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"),
        _order(docs, id_col, text_col, seed).alias("order")).withColumn("slice", _slice(F.col("order"))))
    sources = cut(narrow.groupBy("source").agg(F.sum("size").alias("size")))
    n_sources = sources.count()
    if weights is None:
        weights = by_rank(sources.select("source"), cycle)
    right = weights.groupBy(F.col("source").cast("string").alias("_of")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    sources = cut(sources.join(right, sources["source"].eqNullSafe(right["_of"]), "left").drop("_of").fillna({"weight": 0.0}))
    total = sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    level, _ = water_fill(sources, total, max_epochs)
    target = F.least(F.lit(level) * F.col("weight"), F.col("size") * F.lit(float(max_epochs)))
    plan = sources.select("source", F.col("size").alias("source_size"), target.alias("target"))
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long"))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    plan = plan.withColumn("rest", F.when(rest >= 0.5, rest).otherwise(0.0))  # less than a word is rounding
    plan = cut(plan)
    fill = _fill(narrow, plan, n_sources).withColumnRenamed("source", "_of")
    return narrow, cut(plan.join(fill, plan["source"].eqNullSafe(fill["_of"])).drop("_of")), n_sources


def by_rank(sources: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """(source, weight): sources in code point order, null last, take the weights of ``cycle`` in turn.

    The rank comes from a range partitioning: ranks inside a range, plus the row counts of the ranges before it.
    """
    ranged = cut(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    place = ranged.withColumn("inside", inside).join(F.broadcast(starts), "range")  # one row per partition
    turn = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (F.pmod(F.col("inside") + F.col("start"), F.lit(len(cycle))) + 1).cast("int"))
    return place.select("source", turn.alias("weight"))
