"""Merkle manifest of a table: a leaf per row, a tree per language, a tree of their roots.

Leaves are put in order by one range shuffle of narrow rows; a table with one row per
partition and group turns places within a partition into places within a group. An
aligned block of 2**BITS consecutive nodes keeps each of its levels as one string of
concatenated 64-character names: parents are hashes of its 128-character substrings,
siblings are the flanking 64-character substrings. A block's topmost name is a node of
the next tier, which is cut into blocks in turn, so no task sees more than one block
however large a group is, and a path is the path inside the block followed by the
block's own path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.base import Scratch

BITS = 10
NAME = 64
TAMPER = 7

_PARENTS = (
    "array_join(transform(sequence(0, cast((octet_length({0}) - 1) div 128 as int)),"
    " i -> sha2(substring({0}, 128 * i + 1, 128), 256)), '')"
)
#: All levels of a block, the lowest first.
_LEVELS = (
    "aggregate(if(depth = 0, array(), sequence(1, depth)), array(encode(nodes, 'UTF-8')),"
    f" (done, k) -> concat(done, array(encode({_PARENTS.format('element_at(done, -1)')}, 'UTF-8'))))"
)
#: Path of place i: per level '' for a lone node, else the sibling's side and name.
_STEPS = (
    "transform(if(depth = 0, array(), sequence(0, depth - 1)), k ->"
    " case when shiftright(i, k) % 2 = 1 then concat('L', decode(substring(levels[k], 64 * (shiftright(i, k) - 1) + 1, 64), 'UTF-8'))"
    " when octet_length(levels[k]) > 64 * (shiftright(i, k) + 1) then concat('R', decode(substring(levels[k], 64 * (shiftright(i, k) + 1) + 1, 64), 'UTF-8'))"
    " else '' end)"
)


def digest(*fields: Column) -> Column:
    """Lowercase hex sha256 of the fields, each `-` if NULL, else its UTF-8 byte count, `:`, itself."""
    coded = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*coded).cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    sibling = lambda s: F.substring(s, 2, NAME)
    up = lambda h, s: F.when(s.startswith("L"), F.concat(sibling(s), h)).when(s.startswith("R"), F.concat(h, sibling(s))).otherwise(h)
    return F.aggregate(path, leaf, lambda h, s: F.sha2(up(h, s).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.substring(s, 2, NAME)), "").cast("binary"), 256)


def _placed(nodes: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """(grp, node, row) with the place ``at`` in the group, from 0, and the group's size ``n``.

    Rows are ordered by range partitions. The ordered table is written, so that numbers
    taken from its partitions stay the same when a task runs again.
    """
    ordered = nodes.repartitionByRange("grp", *order, "node").sortWithinPartitions("grp", *order, "node")
    ordered = scratch.put(
        ordered.select("grp", "node", "row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("line")), name
    )
    from pyspark.sql import Window

    group = Window.partitionBy("grp")
    starts = ordered.groupBy("grp", "part").agg(F.min("line").alias("first"), F.count("*").alias("here"))
    starts = starts.select(
        "grp",
        "part",
        (F.sum("here").over(group.orderBy("part")) - F.col("here") - F.col("first")).alias("shift"),
        F.sum("here").over(group).alias("n"),
    )
    return ordered.join(starts, ["grp", "part"]).select("grp", (F.col("line") + F.col("shift")).alias("at"), "node", "row", "n")


def climb(nodes: DataFrame, scratch: Scratch, name: str, bits: int = BITS) -> DataFrame:
    """(grp, at, node, row, n) to (grp, at, node, row, path, root).

    Within a group the nodes at places 0 to n-1 are hashed two by two, an odd last one
    alone, until one is left.
    """
    width = 1 << bits
    single = F.col("n") <= width
    blocks = nodes.groupBy("grp", F.shiftright("at", bits).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("at", "node", "row"))).alias("members"), F.max("n").alias("n")
    )
    depth = F.when(single, F.ceil(F.log2(F.col("n").cast("double"))).cast("int")).otherwise(bits)
    blocks = blocks.withColumn("depth", depth).withColumn("nodes", F.array_join("members.node", ""))
    blocks = blocks.withColumn("levels", F.expr(_LEVELS)).drop("nodes")
    blocks = scratch.put(blocks, f"{name}blocks")
    tops = blocks.select(
        "grp", F.col("block").alias("at"), F.element_at("levels", -1).cast("string").alias("node"), F.lit(0).alias("row"), F.ceil(F.col("n") / width).alias("n")
    )
    if nodes.filter(~single).isEmpty():
        above = tops.select("grp", "at", F.array().cast("array<string>").alias("path"), F.col("node").alias("root"))
    else:
        above = climb(tops, scratch, f"{name}-", bits)
    above = above.select("grp", F.col("at").alias("block"), F.col("path").alias("above"), "root")
    rows = blocks.join(above, ["grp", "block"]).select("grp", "depth", "levels", "above", "root", F.posexplode("members").alias("i", "m"))
    return rows.select("grp", "m.at", "m.node", "m.row", F.concat(F.expr(_STEPS), "above").alias("path"), "root")


def merkle_manifest(docs: DataFrame, with_path: bool = False, bits: int = BITS) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Columns doc_id, source, lang, n_chars and text are hashed, NULLs as such; others are
    not read. NULL is a language of its own, before all others. Rows of one language and
    doc_id follow one another by leaf (NULL ids first), so the result does not depend on
    the order of the input; equal rows have equal leaves and differ in their paths alone.
    The check row is the tampered one where TAMPER divides the id's checksum (never for
    NULL ids), with 1 added to n_chars unless that is NULL. An empty table gives no row.
    ``with_path`` adds the path, per level '' or the side (L, R) and name of the sibling.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    text = lambda c: F.col(c).cast("string")
    fields = lambda n_chars: digest(text("doc_id"), text("source"), text("lang"), n_chars, text("text"))
    one_more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    struck = F.crc32(text("doc_id").cast("binary")) % TAMPER == 0
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("x"), text("lang")), F.lit("")).alias("grp"),
        F.col("doc_id").alias("id"),
        fields(text("n_chars")).alias("node"),
        F.struct(F.col("doc_id").alias("id"), F.when(struck, fields(one_more)).alias("tampered")).alias("row"),
    )
    leaves = scratch.put(leaves, "leaves")
    trees = climb(_placed(leaves, ["id"], scratch, "ordered"), scratch, "tree", bits)

    tops = trees.filter("at = 0").select(F.lit("").alias("grp"), F.col("grp").alias("lang"), F.col("root").alias("node"), F.col("grp").alias("row"))
    tops = climb(_placed(tops, ["lang"], scratch, "langs"), scratch, "top", bits)
    tops = tops.select(F.col("row").alias("grp"), F.col("path").alias("top"), F.col("root").alias("whole"))

    rows = trees.join(tops, "grp").select(
        F.col("row.id").alias("doc_id"),
        F.col("node").alias("leaf"),
        F.col("root").alias("subroot"),
        F.col("whole").alias("root"),
        F.concat("path", "top").alias("path"),
        F.coalesce("row.tampered", "node").alias("_check"),
    )
    rows = rows.select("*", folded(F.col("_check"), F.col("path")).alias("folded_root"))
    shown = ["doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")]
    return rows.select(*shown, *(["path"] if with_path else []))
