"""Exact duplicates by deterministic block naming, in DataFrame operations only.

Texts are cut into blocks of a fixed number of characters. Sorting the distinct blocks
within its partition gives each an integer name; then pairs of adjacent names are sorted
and named in turn, until one name is left per text. Texts of equal length have the same number of rounds,
so equal (length, name) means equal text, with no chance of a collision.

Texts that share neither length nor checksum with another differ for sure and keep out
of the naming. No range sample of
blocks reaches the driver; equal blocks meet in map-side aggregation,
so a group of copies of any size costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.base import SPACES, Scratch

BLOCK = 4096
ROW, PLACE, NAME = "_row", "_place", "_name"


def normalised(text: Column) -> Column:
    """Runs of white space become one space; NULL becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _named(parts: DataFrame, by: list[str], scratch: Scratch, step: str) -> DataFrame:
    """Put an integer name for the values of ``by`` in their place.

    Equal values meet in one partition; each partition is sorted and numbered in order.
    """
    names = scratch.put(
        parts.select(*by).distinct().sortWithinPartitions(*by).withColumn(NAME, F.monotonically_increasing_id()),
        f"names{step}",
    )
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"n.{c}")) for c in by]
    joined = parts.alias("p").join(names.alias("n"), same)
    return joined.select(f"p.{ROW}", f"p.{PLACE}", f"n.{NAME}")


def block_names(texts: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(_row, text) to (_row, _name): equal texts of equal length get equal names."""
    cut = F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % block), F.lit(0))
    blocks = texts.select(
        ROW, F.posexplode(F.when(F.length("text") > 0, cut).otherwise(F.array(F.lit("")))).alias(PLACE, "block")
    )
    level = 0
    at = scratch.put(_named(blocks, ["block"], scratch, "0"), "level0")
    done = None
    while True:
        ends = at.groupBy(ROW).agg(F.max(PLACE).alias("last"), F.max(NAME).alias(NAME))
        ends = scratch.put(ends, f"ends{level}")
        single = ends.filter("last = 0").select(ROW, NAME)
        done = single if done is None else done.unionByName(single)
        open_rows = ends.filter("last > 0").select(ROW)
        if open_rows.isEmpty():
            return done
        pairs = (
            at.join(open_rows, ROW)
            .groupBy(ROW, F.shiftright(PLACE, 1).alias(PLACE))
            .agg(
                F.max(F.when(F.col(PLACE) % 2 == 0, F.col(NAME))).alias("left"),
                F.max(F.when(F.col(PLACE) % 2 == 1, F.col(NAME))).alias("right"),
            )
        )
        level += 1
        pairs = scratch.put(pairs, f"pairs{level}")
        at = scratch.put(_named(pairs, ["left", "right"], scratch, str(level)), f"level{level}")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the smallest id of each group of equal texts is kept (NULL ids come
    last); of repeated rows with that id, one. NULL text counts as empty. Only the two
    named columns are read, so further columns do no harm; an empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    source = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    signed = source.select(
        "doc_id",
        F.length("text").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("crc"),
        F.unhex(F.sha2("text", 256)).alias("sha"),
    )
    rows = scratch.put(signed, "rows")
    shared = scratch.put(rows.groupBy("size", "crc").count().filter("count > 1").select("size", "crc"), "shared")
    # the source is read again: only texts with a partner travel further
    texts = scratch.put(
        source.withColumn("size", F.length("text"))
        .withColumn("crc", F.crc32(F.col("text").cast("binary")))
        .join(shared, ["size", "crc"], "left_semi")
        .withColumn(ROW, F.monotonically_increasing_id()),
        "texts",
    )
    names = block_names(texts.select(ROW, "text"), scratch, block)
    members = scratch.put(
        texts.select(ROW, "doc_id", "size", F.unhex(F.sha2("text", 256)).alias("sha")).join(names, ROW), "members"
    )
    scratch.drop("texts")
    members = members.groupBy("size", NAME, "doc_id", "sha").agg(F.count("*").alias("times"))
    groups = members.groupBy("size", NAME).agg(
        F.min("doc_id").alias("keep_id"), F.sum("times").alias("group_size")
    )
    named = members.join(groups, ["size", NAME]).select("doc_id", "sha", "times", "keep_id", "group_size")
    single = (
        rows.join(shared, ["size", "crc"], "left_anti")
        .select("doc_id", "sha", F.lit(1).cast("long").alias("times"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    )
    # repeated rows come back one by one, in two steps so that no array grows with them
    some = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(times - 1) div 1000")))
    copy = F.explode(F.sequence(F.expr("some * 1000 + 1"), F.expr("least(times, some * 1000 + 1000)")))
    return (
        named.unionByName(single)
        .withColumn("some", some)
        .withColumn("copy", copy)
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )
