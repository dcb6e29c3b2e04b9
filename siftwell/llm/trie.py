"""The prefix trie of conversations by partition refinement.

All conversations start in one class. In a round a class moves on as far as all its members agree (one aggregation by place) and is
split by the turn where they part. A class of one member is retired: the rest of it is a unary chain, written down from its length
alone. A class of at most LOCAL turns is refined to its end by one task, many classes at once, in the same way: split by turn,
retire single members. Only larger classes go into the next round, so rounds are as many as there are branchings one below the other
in large classes. Then the rounds' branches are folded back, from the last to the first: leaves and savings of a class are those of
the classes that it was split into, summed up along its chain.

A turn is told by the SHA-256 of its role and text. A node is told by its smallest conversation and its depth. Members that take a hot
way (a third of all) are joined by counts known before; conversations that end at one node are sorted over many tasks, and one task reads
no more of them than the string that it has to hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, stage

#: Classes of at most so many turns are refined to their end in a task.
LOCAL = 2_000
#: Turns of such classes that a task holds at once.
TURNS_AT_ONCE = 200_000
#: A chain's nodes are made in blocks of so many, a node's list of conversations in strings of so many bytes.
BLOCK, CHUNK = 4096, 1 << 20
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
EMPTY = hashlib.sha256(b"").hexdigest()


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def number_turns(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, digest, chars): the turns of each conversation, numbered from 0 in order of ``turn`` (null first), role and text;
    of each the SHA-256 of role and text and the text's code points.

    Null roles and texts become empty; very long texts are hashed in their row. Rows are sorted by ranges, so that a conversation with a
    third of all rows is numbered by many tasks. Repeated rows are turns each (ties of all columns are alike). Rows without a conversation
    are left out: they belong to none. An empty table gives an empty result. Other columns are ignored.
    """
    turns = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = turns.where("conv_id IS NOT NULL").repartitionByRange(F.col("conv_id"), *order).sortWithinPartitions(F.col("conv_id"), *order)
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = rows.select("conv_id", F.unhex(_sha(said)).alias("digest"), F.length("text").cast("long").alias("chars"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"))
    rows = stage(rows)
    # neighbouring ranges share a conversation at most, so what is broadcast has a row for each range
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    going_on = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(earlier)).where("before IS NOT NULL").drop("n")
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("place")).cast("long") - 1
    numbered = rows.withColumn("pos", inside).join(F.broadcast(going_on), ["conv_id", "part"], "left")
    return stage(numbered.select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0).cast("long"))).alias("pos"), "digest", "chars"))


def refine(top: np.ndarray, conv: np.ndarray, begin: np.ndarray, length: np.ndarray, code: np.ndarray, chars: np.ndarray, tops: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Classes refined to their end.

    Of each member: its class ``top``, its id (ascending in a class), where its turns begin and how many there are; of each turn a code
    and its characters; ``tops``: of each class (id, depth, parent, members, characters). Gives the nodes (conv, depth, parent's conv,
    members, children, leaves, saved), the classes' own first, and at which node each member ends.
    """
    node = top.copy()
    nodes = [[x] for x in (*tops[:4], tops[4], np.full(len(tops[0]), -1, np.int64))]  # conv, depth, parent's conv, members, chars, parent
    made, step, ends, codes = len(tops[0]), 0, node.copy(), int(code.max()) + 1
    depth_of = tops[1][top]
    active = np.flatnonzero(length > 0)

    def add(conv_, depth_, parent_conv, members, chars_, parent) -> np.ndarray:
        nonlocal made
        for kept, x in zip(nodes, (conv_, depth_, parent_conv, members, chars_, parent), strict=True):
            kept.append(x)
        made += len(conv_)
        return np.arange(made - len(conv_), made)

    node_conv = tops[0][top]  # the smallest member of each member's node
    while len(active):
        at = begin[active] + step
        _, first, inverse, count = np.unique(node[active] * codes + code[at], return_index=True, return_inverse=True, return_counts=True)
        smallest = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(smallest, inverse, conv[active])
        new = add(smallest, depth_of[active[first]] + step + 1, node_conv[active[first]], count, chars[at[first]], node[active[first]])
        node[active], node_conv[active] = new[inverse], smallest[inverse]
        ends[active] = node[active]
        step += 1
        single = active[count[inverse] == 1]
        tail = length[single] - step
        single, tail = single[tail > 0], tail[tail > 0]
        if len(single):  # retired: the rest is a chain
            owner = np.repeat(np.arange(len(single)), tail)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(tail) - tail, tail)
            ids = made + np.arange(len(owner))
            parent = np.where(within == 0, node[single][owner], ids - 1)
            one = np.ones(len(owner), np.int64)
            add(conv[single][owner], depth_of[single][owner] + step + 1 + within, conv[single][owner], one, 0 * one, parent)
            ends[single] = ids[np.cumsum(tail) - 1]
        active = active[(count[inverse] > 1) & (length[active] > step)]
    conv_, depth_, parent_conv, members, chars_, parent = (np.concatenate(x) for x in nodes)
    children, leaves, saved = np.zeros(made, np.int64), np.zeros(made, np.int64), (members - 1) * chars_
    np.add.at(children, parent[parent >= 0], 1)
    leaves[children == 0] = 1
    order = np.argsort(-depth_, kind="stable")
    edges = np.flatnonzero(np.diff(depth_[order])) + 1
    for same in np.split(order, edges):  # fold back, from the deepest nodes on
        inner = same[parent[same] >= 0]
        np.add.at(leaves, parent[inner], leaves[inner])
        np.add.at(saved, parent[inner], saved[inner])
    return conv_, depth_, parent_conv, members, children, leaves, saved, ends


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, depth, parent, n_convs, chars of the class's own turn, conv_id, pos, digest, chars) in order of class, member and place ->
    NODE, whether it is a class's own node, and (null in nodes) a conversation that ends there."""
    names = [*[c.split()[0] for c in NODE.split(", ")], "is_top", "ended"]

    def refined(table: pa.Table) -> pa.RecordBatch:
        columns = [c.combine_chunks() for c in table.columns]
        cls, depth, parent, members, own, conv = (np.asarray(c.fill_null(0)) for c in columns[:6])
        code = np.asarray(columns[7].dictionary_encode().indices).astype(np.int64)
        begin = np.flatnonzero(np.append(True, (cls[1:] != cls[:-1]) | (conv[1:] != conv[:-1])))
        ids, first, top = np.unique(cls[begin], return_index=True, return_inverse=True)
        first = begin[first]
        tops = (ids, depth[first], parent[first], members[first], own[first])
        *nodes, ends = refine(top, conv[begin], begin, np.diff(np.append(begin, len(cls))), code, np.asarray(columns[8]), tops)
        n, m = len(nodes[0]), len(ends)
        is_top = np.arange(n + m) < len(ids)
        rootless = np.zeros(n + m, bool)
        rootless[: len(ids)] = np.asarray(columns[2].is_null())[first]
        out = [pa.array(np.concatenate([x, x[ends]]), pa.int64(), mask=rootless if k == 2 else None) for k, x in enumerate(nodes)]
        return pa.RecordBatch.from_arrays([*out, pa.array(is_top), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(conv[begin], pa.int64())])], names)

    waiting, held = [], 0
    for batch in batches:
        waiting.append(batch)
        held += batch.num_rows
        if held >= TURNS_AT_ONCE:  # the last class may go on in the next batch; those before it are whole
            table = pa.Table.from_batches(waiting)
            classes = np.asarray(table.column(0).combine_chunks())
            whole = int(np.searchsorted(classes, classes[-1]))
            if whole:
                yield refined(table.slice(0, whole))
            waiting = table.slice(whole).to_batches()
            held -= whole
    if held:
        yield refined(pa.Table.from_batches(waiting))


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, depth, ended) in order -> each node's numbers joined by commas, in strings of about CHUNK bytes."""
    names = ["conv_id", "depth", "first", "ids"]
    key, text, held = None, [], 0
    for batch in batches:
        done = []
        for conv, depth, ended in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if text and (key != (conv, depth) or held >= CHUNK):
                done.append((*key, int(text[0]), ",".join(text)))
                text, held = [], 0
            key = (conv, depth)
            text.append(str(ended))
            held += len(text[-1]) + 1
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names)
    if text:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, int(text[0]), ",".join(text))], names)


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, depth, first, ids) in order -> the SHA-256 of each node's whole list; only its state is held."""
    names = ["conv_id", "depth", "ends_sha256"]
    key, digest = None, None
    for batch in batches:
        done = []
        for conv, depth, _, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != (conv, depth):
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (conv, depth), hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], names)


def end_hashes(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of the nodes where conversations end: (conv_id, depth, ended)."""
    sorted_ = ends.repartitionByRange("conv_id", "depth", "ended").sortWithinPartitions("conv_id", "depth", "ended")
    strings = sorted_.mapInArrow(_join_ids, "conv_id long, depth long, first long, ids string")
    return strings.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(_hash_ids, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The nodes of the trie of conversations: NODE and ``ends_sha256``.

    ``turns`` are (conv_id, pos, digest, chars) as of ``number_turns``; ``conversations`` (conv_id), if given, names all conversations, those
    without turns included. A node is a sequence of turns that some conversation begins with; the root is the empty one. Of each: its
    smallest member, its depth, its parent's smallest member (the root's: null), how many members and children it has, how many
    childless nodes are in its subtree (itself included), the characters that sharing saves there (those of each node's own turn, for
    all members but one), and the SHA-256 of the ids, ascending and joined by commas, of the members that end at it.

    Equal conversations (ties, repeated ones) share all nodes. No conversation gives no node. Repeated ids in ``conversations`` count once,
    null ones not at all; other columns are ignored.
    """
    rows = turns.select("conv_id", "pos", "digest", "chars")
    lengths = rows.groupBy("conv_id").agg(F.count("*").alias("length"))
    if conversations is not None:
        ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).where("conv_id IS NOT NULL").distinct()
        lengths = ids.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0).cast("long")).alias("length"))
    lengths = stage(lengths)
    root = lengths.agg(F.min("conv_id"), F.count("*"), F.sum("length")).first()
    # classes: the smallest member, the depth of the node they are, the class they were split from, members, their turn's characters, turns after it
    schema = "class long, depth long, parent long, n long, chars long, rest long"
    classes = rows.sparkSession.createDataFrame([(root[0], 0, None, root[1], 0, root[2])] if root[1] else [], schema)
    first = zip(("class", "depth", "parent", "n", "chars", "rest"), (root[0], 0, None, root[1], 0, root[2]), strict=True)
    members = lengths.select("conv_id", "length", *[F.lit(x).cast("long").alias(c) for c, x in first])
    alone, shared, ends, rounds = [], [], [], []
    while True:
        members = stage(members)
        alone.append(_chains(members.where("n = 1")))
        flat = classes.where("n > 1 AND rest = 0").selectExpr("class AS conv_id", "depth", "parent AS parent_conv_id", "n AS n_convs", "0L AS n_children", "1L AS n_leaves", "(n - 1) * chars AS saved_tokens")
        several = members.where("n > 1")
        ends.append(several.where(f"rest <= {LOCAL} AND length = depth").selectExpr("class AS conv_id", "depth", "conv_id AS ended"))
        going_on = several.where("rest > 0").selectExpr("conv_id", "length AS n", "class", "depth", "parent", "n AS n_convs", "chars AS own", "rest")
        rows = stage(join_counted(rows, going_on, ["conv_id"]).where("pos >= depth"))
        local = rows.where(f"rest <= {LOCAL}").select("class", "depth", "parent", "n_convs", "own", "conv_id", "pos", "digest", "chars")
        local = stage(local.repartition("class").sortWithinPartitions("class", "conv_id", "pos").mapInArrow(_refine, f"{NODE}, is_top boolean, ended long"))
        shared += [flat, local.where("ended IS NULL").drop("is_top", "ended")]
        ends.append(local.where("ended IS NOT NULL").select("conv_id", "depth", "ended"))
        if rounds:
            done = classes.where("n = 1").selectExpr("parent AS class", "1L AS n_leaves", "0L AS saved_tokens")
            for tops in (flat, local.where("is_top")):
                done = done.unionByName(tops.selectExpr("parent_conv_id AS class", "n_leaves", "saved_tokens"))
            rounds[-1].append(done)
        large = stage(classes.where(f"n > 1 AND rest > {LOCAL}"))
        if large.isEmpty():
            break
        # how far the members of each larger class agree, and how they part there
        rows = rows.where(f"rest > {LOCAL}")
        agreed = (F.count("*") == F.first("n_convs")) & (F.min("digest") == F.max("digest"))
        places = stage(rows.groupBy("class", "pos").agg(agreed.alias("agreed"), F.min("chars").alias("chars")))
        bottoms = places.groupBy("class").agg(F.coalesce(F.min(F.when(~F.col("agreed"), F.col("pos"))), F.max("pos") + 1).alias("bottom"))
        large = stage(large.join(bottoms, "class"))
        below = places.join(large.select("class", "n", "bottom"), "class").where("pos < bottom").selectExpr("class", "pos + 1 AS depth", "class AS parent", "n", "chars", "bottom")
        rounds.append([stage(large.drop("rest").unionByName(below)), large])
        members = stage(join_counted(members.select("conv_id", "length", "class"), large.select("class", "n", "bottom"), ["class"]))
        ends.append(members.where("length = bottom").selectExpr("class AS conv_id", "bottom AS depth", "conv_id AS ended"))
        parting = join_counted(rows.select("conv_id", "pos", "digest", "chars"), members.selectExpr("conv_id", "class", "bottom", "length", "length AS n"), ["conv_id"]).where("pos = bottom").drop("n")
        parting = stage(parting)
        split = parting.groupBy("class", "digest").agg(
            F.min("conv_id").alias("child"), F.count("*").alias("n"), F.min("chars").alias("chars"), F.sum(F.col("length") - F.col("bottom") - 1).alias("rest"), (F.min("bottom") + 1).alias("depth"))
        split = stage(split)
        members = join_counted(parting.select("conv_id", "length", "class", "digest"), split, ["class", "digest"]).selectExpr("conv_id", "length", "child AS class", "depth", "class AS parent", "n", "chars", "rest")
        classes = split.selectExpr("child AS class", "depth", "class AS parent", "n", "chars", "rest")
        rows = rows.select("conv_id", "pos", "digest", "chars")
    shared += _fold_back(rounds)
    nodes, ended, lone = _all(shared), end_hashes(_all(ends)), _all(alone)
    return nodes.join(ended, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))).unionByName(lone)


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def _chains(single: DataFrame) -> DataFrame:
    """The nodes of classes of one member (conv_id, length, depth, parent): a chain down to its end."""
    blocks = single.select("conv_id", "length", "depth", "parent", F.explode(F.sequence("depth", "length", F.lit(BLOCK).cast("long"))).alias("low"))
    nodes = blocks.select("*", F.explode(F.sequence("low", F.least(F.col("low") + BLOCK - 1, "length"))).alias("at"))
    return nodes.select(
        "conv_id", F.col("at").alias("depth"), F.when(F.col("at") == F.col("depth"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        (F.col("at") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("at") == F.col("length"), _sha(F.col("conv_id").cast("string"))).otherwise(F.lit(EMPTY)).alias("ends_sha256"))


def _fold_back(rounds: list[list[DataFrame]]) -> list[DataFrame]:
    """The nodes of each round's chains, from (chains, classes, what was finished below them), the last round first."""
    nodes, above = [], None
    for chains, large, done in reversed(rounds):
        below = done if above is None else done.unionByName(above)
        sums = below.groupBy("class").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        upwards = Window.partitionBy("class").orderBy(F.col("depth").desc())
        zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
        folded = chains.join(sums, "class", "left").select(
            F.col("class").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(F.col("depth") < F.col("bottom"), one).otherwise(F.coalesce("n_children", zero)).alias("n_children"), F.coalesce("n_leaves", one).alias("n_leaves"),
            (F.sum((F.col("n") - 1) * F.col("chars")).over(upwards) + F.coalesce("below", zero)).cast("long").alias("saved_tokens"))
        nodes.append(stage(folded))
        above = nodes[-1].join(large.select(F.col("class").alias("conv_id"), "depth"), ["conv_id", "depth"], "left_semi").selectExpr("parent_conv_id AS class", "n_leaves", "saved_tokens")
    return nodes
