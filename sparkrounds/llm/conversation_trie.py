"""A prefix trie of conversations, by collapsing whole sequences first.

Identical conversations become one weighted sequence with a list of its ends.
Only one conversation of each sequence goes on, so copies cost nothing more.
Sequences that are proper prefixes of others fall to an anti-join; the rest are
the leaves.  Nodes are aggregates of weighted prefixes, and what sums over
subtrees runs along the leaves' paths: every node is counted on one path only,
that of the smallest leaf below it.

A sequence is named by 128 bits, the exclusive or of two hashes of every
(position, SHA-256 of the turn).  Such names add up from any pieces, so a
conversation of any length is ranked and summed in pieces: by ranges of rows,
and by blocks of positions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrounds.functions.checks import require
from sparkrounds.llm.common import word_count
from sparkrounds.plans.lineage import discard, materialize

#: Positions of a path that one window task orders together.
BLOCK = 4096
#: Ids per piece of an end list: pieces are ranges of ids, so none is longer.
ENDS = 4096
NAME = ["a", "b", "depth"]


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; null is empty."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, ord (from 1), digest and words of every turn that has a conv_id.

    Turns are ordered by ``turn``, null first, equal ones by digest.  Rows are
    dealt by ranges of that order, so a long conversation spreads over many tasks.
    """
    require(turns, "conv_id", "turn", "role", "text", what="turns")
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        turn_digest(F.col("role"), F.col("text")).alias("digest"), word_count(F.col("text")).alias("words"),
    )
    ranged = rows.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "digest")
    ranged = materialize(ranged.withColumn("pid", F.spark_partition_id()), "trie-turns")
    before = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = ranged.groupBy("conv_id", "pid").agg(F.count(F.lit(1)).alias("rows")).select(
        "conv_id", "pid", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("done")
    )
    within = F.row_number().over(Window.partitionBy("conv_id", "pid").orderBy(F.asc_nulls_first("turn"), "digest"))
    placed = ranged.withColumn("ord", within).join(pieces.filter("done > 0"), ["conv_id", "pid"], "left")
    return placed.select(
        "conv_id", (F.col("ord") + F.coalesce("done", F.lit(0))).cast("long").alias("ord"), "digest", "words"
    )


def rebuilt(turns: DataFrame, *, head: int = 4, group: int = 20) -> tuple[DataFrame, DataFrame]:
    """All conv_ids, and conv_id, pos, digest and words of every rebuilt turn.

    Conversation c takes the first h turns of c - c % group, h = crc32(c) % head,
    and then its own from the (h+1)-th on.
    """
    own = materialize(numbered_turns(turns), "trie-numbered")
    lengths = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % head).alias("h")
    plan = lengths.select("conv_id", taken, (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    sizes = lengths.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"))
    plan = plan.join(sizes, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_len", F.lit(0))).alias("k")
    )
    plan = materialize(plan, "trie-plan")
    heads = own.filter(F.col("ord") < head).select(F.col("conv_id").alias("base"), "ord", "digest", "words")
    first = plan.filter("k > 0").join(heads, "base").filter("ord <= k")
    rest = own.join(plan, "conv_id").filter("ord > h").withColumn("ord", F.col("ord") - F.col("h") + F.col("k"))
    columns = ["conv_id", F.col("ord").cast("long").alias("pos"), "digest", "words"]
    return plan.select("conv_id"), first.select(*columns).unionByName(rest.select(*columns))


def running(rows: DataFrame, totals: dict[str, tuple[str, str]]) -> DataFrame:
    """Running aggregates along each conversation's positions, in blocks.

    ``totals`` maps an output column to an aggregate that composes (``sum`` or
    ``bit_xor``) and its input column.
    """
    add = {"sum": lambda x, y: x + y, "bit_xor": lambda x, y: x.bitwiseXOR(y)}
    rows = rows.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK))
    within = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *[F.expr(f"{f}({c})").over(within).alias(name) for name, (f, c) in totals.items()])
    # Only paths longer than a block have anything to carry.
    blocks = rows.groupBy("conv_id", "block").agg(*[F.expr(f"{f}({c})").alias(n) for n, (f, c) in totals.items()])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        "conv_id", "block", *[F.expr(f"{f}({n})").over(before).alias(f"{n}_before") for n, (f, _) in totals.items()]
    ).filter("block > 0")
    out = out.join(carried, ["conv_id", "block"], "left")
    for name, (f, _) in totals.items():
        out = out.withColumn(name, add[f](F.col(name), F.coalesce(f"{name}_before", F.lit(0).cast("long"))))
    return out.drop("block", *[f"{n}_before" for n in totals])


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each sequence of a sorted partition; holds a batch of pieces at a time."""
    now, digest = None, None

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * 4
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds)], [*NAME, "ends_sha256"]
        )

    for batch in batches:
        done = []
        names = list(zip(*(batch.column(c).to_pylist() for c in NAME)))
        for name, ids in zip(names, batch.column("ids")):
            if name != now:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = name, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.as_py().encode())
        yield rows(done)
    if now is not None:
        yield rows([(*now, digest.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """a, b, depth and the SHA-256 of each sequence's conv_ids, in numeric order, joined by commas.

    Lists are joined in pieces of at most ``ENDS`` ids.  A digest must read its
    pieces one after the other; a task does that holding one piece.
    """
    pieces = ends.groupBy(*NAME, F.floor(F.col("conv_id") / ENDS).alias("piece")).agg(
        F.expr("array_join(transform(sort_array(collect_list(conv_id)), x -> string(x)), ',')").alias("ids")
    )
    return (
        pieces.repartition(*NAME).sortWithinPartitions(*NAME, "piece")
        .select(*NAME, "ids").mapInArrow(_hash_ends, "a long, b long, depth long, ends_sha256 string")
    )


def conversation_trie(turns: DataFrame, *, head: int = 4, group: int = 20) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations: one row per distinct prefix.

    ``turns`` has conv_id, turn, role and text; other columns are not read, rows
    without conv_id take no part, null roles and texts are empty, repeated rows
    are turns of their own.  An empty table gives no rows, not even a root; else
    the root is the row of depth 0 without parent.  ``n_convs`` counts the
    conversations that start with the node, ``n_leaves`` the childless nodes of
    its subtree, ``saved_tokens`` the words that its subtree's shared last turns
    would repeat; ``ends_sha256`` hashes the ids of those that end here.
    """
    convs, rows = rebuilt(turns, head=head, group=group)
    words = F.xxhash64("digest", "pos").alias("x"), F.xxhash64("pos", "digest", F.lit(7)).alias("y")
    rows = materialize(rows.select("conv_id", "pos", "words", *words), "trie-rebuilt")

    # Whole sequences and where they end.
    whole = rows.groupBy("conv_id").agg(
        F.expr("bit_xor(x)").alias("a"), F.expr("bit_xor(y)").alias("b"), F.count(F.lit(1)).alias("depth")
    )
    ends = materialize(whole, "trie-ends")
    silent = convs.join(ends, "conv_id", "left_anti").select(
        "conv_id", *[F.lit(0).cast("long").alias(c) for c in NAME]
    )
    ends = ends.unionByName(silent)
    sequences = ends.groupBy(*NAME).agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id"))
    sequences = materialize(sequences, "trie-sequences")

    # Prefixes of one conversation for each sequence, weighted.
    paths = rows.join(sequences.select("conv_id", "weight"), "conv_id")
    paths = running(paths, {"a": ("bit_xor", "x"), "b": ("bit_xor", "y")})
    paths = materialize(
        paths.select(
            "conv_id", F.col("pos").alias("depth"), "a", "b", "weight", "words",
            F.expr("a ^ x").alias("up_a"), F.expr("b ^ y").alias("up_b"),
        ),
        "trie-paths",
    )
    nodes = paths.groupBy(*NAME).agg(
        F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.min("words").alias("words"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"),
    )
    nodes = materialize(nodes, "trie-nodes")
    children = nodes.groupBy(
        F.col("up_a").alias("a"), F.col("up_b").alias("b"), (F.col("depth") - 1).alias("depth")
    ).agg(F.count(F.lit(1)).alias("n_children"))
    children = materialize(children, "trie-children")

    # Leaves: sequences that are no proper prefix.
    leaves = sequences.filter("depth > 0").join(children, NAME, "left_anti").select("conv_id")
    ways = materialize(paths.select("conv_id", *NAME).join(leaves, "conv_id", "left_semi"), "trie-ways")
    below = ways.groupBy(*NAME).agg(F.count(F.lit(1)).alias("n_leaves"), F.min("conv_id").alias("way"))
    nodes = materialize(nodes.join(below, NAME).join(children, NAME, "left"), "trie-counted")

    # Every node's saving stands on one path; what lies at or beyond a depth is its node's share of that path.
    saving = nodes.select(
        F.col("way").alias("conv_id"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
    )
    valued = ways.join(saving, ["conv_id", "depth"], "left").withColumn("saved", F.coalesce("saved", F.lit(0)))
    totals = saving.groupBy("conv_id").agg(F.sum("saved").alias("all_saved"))
    along = running(valued.withColumn("pos", F.col("depth")), {"so_far": ("sum", "saved")}).drop("pos")
    along = along.join(totals, "conv_id", "left").select(
        *NAME, (F.coalesce("all_saved", F.lit(0)) - F.col("so_far") + F.col("saved")).alias("share")
    )
    saved = along.groupBy(*NAME).agg(F.sum("share").alias("saved_tokens"))

    parents = nodes.select(
        F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("depth").alias("up"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n")).first()
    root_conv = F.lit(top["conv_id"]).cast("long")
    parent = F.when(F.col("depth") == 1, root_conv).otherwise(F.col("parent_conv_id"))
    inner = (
        nodes.join(saved, NAME).withColumn("up", F.col("depth") - 1)
        .join(parents, ["up_a", "up_b", "up"], "left")
        .withColumn("parent_conv_id", parent)
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    )
    none = F.lit(0).cast("long")
    root = nodes.agg(
        F.count_if(F.col("depth") == 1).alias("n_children"),
        F.greatest(F.count_if(F.col("n_children").isNull()), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum((F.col("n_convs") - 1) * F.col("words")), none).alias("saved_tokens"),
    ).select(
        "*", none.alias("a"), none.alias("b"), root_conv.alias("conv_id"), none.alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.lit(top["n"]).cast("long").alias("n_convs"),
    )
    columns = ["a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    inner = inner.select(*columns)
    if top["n"]:
        inner = inner.unionByName(root.select(*columns))
    empty = hashlib.sha256(b"").hexdigest()
    out = inner.join(end_digests(ends), NAME, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )
    out = materialize(out, "trie-out")
    discard(rows, paths, ways)
    return out
