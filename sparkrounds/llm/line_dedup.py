"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame operations only.

Two lines within one edit either have a common variant with one character
deleted at the same place, or one is the other with a character deleted.  Every
line that could have such a partner emits its variants as hashed keys.  Lines
that meet under "deleted at place i" differ there at most; lines that meet a
whole line differ from it by that one character.  So the earliest line of a key
stands for all its earlier partners and no pairs are listed.  What is found is
verified by edit distance.

Only lines that share a first or last half with another line of fitting length
can lie within one edit, and only blocks of them outside of which the lines agree
can hold the edit, so only these blocks emit variants.  A variant's key combines
the hashes of what lies before, in and after its block, so a long line costs
little more than its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrounds.functions.sizing import broadcast_if_small
from sparkrounds.llm.common import packed, unpacked
from sparkrounds.plans.lineage import materialize, materialize_counted

MIN_CHARS = 20
BLOCK = 64
# Tables of candidates or repeated lines of at most so many rows are broadcast.
BROADCAST_LINES = 200_000


def _ids(key: str, text: str) -> list[Column]:
    return [
        F.col(f"`{key}`").cast("long").alias("doc"),
        # With the key this names a row; rows that repeat both are one document.
        F.xxhash64(F.col(f"`{text}`")).alias("body"),
    ]


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, body, pos, line and digest of every line that is not blank."""
    rows = docs.select(*_ids(key, text), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.select("doc", "body", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.filter(r"line RLIKE '[^\\s]'").withColumn("digest", F.unhex(F.sha2("line", 256)))


def _half_keys() -> str:
    """Hashes of the halves that a line shares with any line within one edit."""
    halves = []
    for m in ("(n - 1) div 2", "n div 2"):
        halves += [f"xxhash64('a', {m}, left(line, {m}))", f"xxhash64('z', {m}, right(line, {m}))"]
    return f"if(n >= {MIN_CHARS}, array_distinct(array({', '.join(halves)})), array())"


def _open_blocks(lines: DataFrame) -> DataFrame:
    """The blocks of ``lines`` outside of which another line is the same.

    Lines of equal length agree before and after the block; of lines whose length
    differs by one, the shorter one's block is a character shorter.  A line that fills
    its blocks has an empty one more, where a longer line may have its last character.
    """
    n = F.length("line")
    blocks = lines.withColumn("n", n).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.expr(f"n div {BLOCK}")))
    )
    blocks = materialize(
        blocks.select(
            "digest", "first", "n", "j",
            F.expr(f"xxhash64(left(line, {BLOCK} * j))").alias("before"),
            F.expr(f"substring(line, {BLOCK} * j + 1, {BLOCK})").alias("mid"),
            F.expr(f"xxhash64(substring(line, {BLOCK} * (j + 1) + 1))").alias("after"),
            F.expr(f"xxhash64(substring(line, {BLOCK} * (j + 1)))").alias("after_less"),
        ),
        "line-blocks",
    )
    roles = blocks.select(
        "digest", "j",
        F.expr(
            "explode(array("
            "struct(xxhash64('same', j, n, before, after) AS key, 0 AS role),"
            "struct(xxhash64('less', j, n - 1, before, after) AS key, 1 AS role),"
            "struct(xxhash64('less', j, n, before, after_less) AS key, 2 AS role)))"
        ).alias("r"),
    ).select("digest", "j", "r.*")
    met = roles.groupBy("key").agg(
        F.count(F.lit(1)).alias("lines"), F.min("role").alias("low"), F.max("role").alias("high")
    ).filter("if(low = 0, lines > 1, low < high)")
    shared = roles.join(met.select("key"), "key").select("digest", "j").distinct()
    return blocks.join(shared, ["digest", "j"])


def _variants(lines: DataFrame) -> DataFrame:
    """digest, first and the key and kind of the variants of ``lines`` that may meet others.

    Kinds: ``at`` a deletion at a given place, ``cut`` a deletion anywhere, ``all``
    the whole line.
    """
    # All keys carry the block, the resulting length and its three parts' hashes.
    less = "concat(left(mid, i - 1), substring(mid, i + 1))"
    each = "if(mid = '', CAST(array() AS array<int>), sequence(1, length(mid)))"
    keyed = _open_blocks(lines).select(
        "digest", "first",
        F.expr(
            "explode(concat("
            f"transform({each}, i -> struct(xxhash64(j, n, before, i, {less}, after) AS key, 'at' AS kind)),"
            f"array_distinct(transform({each}, i -> struct(xxhash64(j, n - 1, before, {less}, after) AS key, 'cut' AS kind))),"
            f"array(struct(xxhash64(j, n, before, left(mid, {BLOCK} - 1), after_less) AS key, 'all' AS kind))))"
        ).alias("v"),
    )
    return keyed.select("digest", "first", "v.key", "v.kind")


def near_lines(lines: DataFrame) -> DataFrame:
    """digest of every line after whose first place an earlier line within one edit exists.

    ``lines`` has one row per distinct line: digest, first (a struct that orders
    them) and line.
    """
    keyed = materialize(_variants(lines), "line-variants")
    at = keyed.filter("kind = 'at'").groupBy("key").agg(
        F.min("first").alias("early"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1")
    whole = keyed.filter("kind <> 'at'").groupBy("key").agg(
        F.expr("min(first) FILTER (WHERE kind = 'all')").alias("base"),
        F.expr("min(first) FILTER (WHERE kind = 'cut')").alias("cut"),
    ).filter("base IS NOT NULL AND cut IS NOT NULL")
    same_place = keyed.filter("kind = 'at'").join(at, "key").select("digest", "first", "early")
    longer = keyed.filter("kind = 'cut'").join(whole, "key").select(
        "digest", "first", F.col("base").alias("early")
    )
    shorter = keyed.filter("kind = 'all'").join(whole, "key").select(
        "digest", "first", F.col("cut").alias("early")
    )
    # One earlier partner proves the case; hashed keys are verified on the lines.
    pairs = same_place.unionByName(longer).unionByName(shorter).filter("early < first").distinct()
    text = lines.select("digest", "line")
    partner = lines.select(F.col("first").alias("early"), F.col("line").alias("other"))
    return (
        pairs.join(text, "digest").join(partner, "early")
        .filter("levenshtein(line, other, 1) BETWEEN 0 AND 1")
        .select("digest").distinct()
    )


def dedup_lines(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with repeated lines removed from ``text``, and n_lines, n_exact and n_near.

    Lines are split at line feeds and ordered by key (null first), hash of the
    text, and position.  A line that occurs earlier is dropped (n_exact); a line
    of at least ``MIN_CHARS`` characters is dropped wherever it stands if one edit
    makes it a line, of that length too, whose first place is earlier (n_near).
    Blank lines stay.  Null text has no lines and stays null; rows that repeat
    both key and text are one document and share its result.  An empty table
    gives no rows.  Columns named like an added one are replaced.
    """
    columns = docs.columns
    lines = _lines(docs, key, text).withColumn("n", F.length("line"))
    firsts = lines.groupBy("digest").agg(
        F.min(F.struct("doc", "body", "pos")).alias("first"),
        F.count(F.lit(1)).alias("places"),
        F.first(F.expr(_half_keys())).alias("halves"),
    )
    firsts = materialize(firsts, "line-firsts")
    halves = firsts.select("digest", "first", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("half")
    near, n = materialize_counted(
        halves.join(shared, "half").select("digest", "first").distinct(), "line-candidates"
    )
    found = near.select("digest", "first", F.col("first.doc").alias("d"), F.col("first.body").alias("b"), F.col("first.pos").alias("p"))
    rows = docs.select(*_ids(key, text), F.col(f"`{text}`").cast("string").alias("text"))
    texts = (
        rows.join(
            broadcast_if_small(found, n, BROADCAST_LINES),
            F.col("doc").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b")),
        )
        .select("digest", "first", F.expr("element_at(split(text, '\n'), p + 1)").alias("line"))
        .dropDuplicates(["digest"])
    )
    close = near_lines(materialize(texts, "line-texts")).withColumn("near", F.lit(True))
    actions, n = materialize_counted(
        firsts.join(close, "digest", "left")
        .filter("places > 1 OR near")
        .select("digest", "first", F.coalesce("near", F.lit(False)).alias("near")),
        "line-actions",
    )
    dropped = (
        lines.select("doc", "body", "pos", "digest")
        .join(broadcast_if_small(actions, n, BROADCAST_LINES), "digest")
        .filter("near OR NOT (first.doc <=> doc AND first.body = body AND first.pos = pos)")
        .groupBy(F.col("doc").alias("d"), F.col("body").alias("b"))
        .agg(
            F.collect_set("pos").alias("gone"),
            F.expr("count(DISTINCT pos) FILTER (WHERE near)").alias("n_near"),
        )
    )
    out = docs.select(packed(docs), *_ids(key, text)).join(
        dropped, F.col("doc").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b")), "left"
    )
    old = F.col(f"row.`{text}`").cast("string")
    kept = F.array_join(F.filter(F.split(old, "\n"), lambda _, i: ~F.array_contains("gone", i)), "\n")
    gone = F.coalesce(F.size("gone"), F.lit(0))
    out = out.select(
        "row",
        F.when(F.col("gone").isNull(), old).otherwise(kept).alias(text),
        F.coalesce(F.size(F.split(old, "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(gone - F.col("n_near")).cast("long").alias("n_exact"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
    done = unpacked(out, columns, text, "n_lines", "n_exact", "n_near")
    return done.select(*columns, *[c for c in ("n_lines", "n_exact", "n_near") if c not in columns])
