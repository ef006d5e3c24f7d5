"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its runs of five words (a shorter text is one shingle). A shingle
weighs its count times the mean weight of its words, 1 + min(1, ln(N/df) / ln 1000):
between 1 for a word in every document and 2 for one in a thousandth or less. The scale
is bounded so that edits inside a large family of copies do not outweigh what it shares.
Document frequencies cover all rows; only words in over a thousandth of them differ from
weight 2, so the table that tasks need has at most 1000 x (mean words a document) rows.

Samples form 12 bands of 3: a pair at similarity 0.8 misses all bands with probability
0.0002. Two documents are candidates if they share a band, their total weights differ by no
more than the similarity allows, and 20 or more of their 36 samples are equal (a pair at
0.8 passes with probability over 0.999). Two rounds compare the documents of a bucket with
one member, which joins large families cheaply. What is still in different classes then
meets in cells: a bucket is a cell, and a pair counts in the first band that it shares.
Texts travel once for each cell in which a document has a candidate, never once a pair; a
cell keeps the shingles of its documents, compares candidates of different classes, and
emits at most one link fewer than it has documents. A bucket of more than ``cell``
documents, or of more than ``CELL_WEIGHT`` shingles, is compared in pairs of blocks: every
two of its documents near enough in weight meet, but for those of its largest class, which
are linked already. Every link is verified on the whole texts by weighted Jaccard
similarity. Identical texts are one node throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.base import Scratch, batch_of, chunks, forget, hashed, mixed, packed_texts, rolling, signed, words
from fleetspark.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
#: Rounds that compare a bucket with one member, before all pairs of different classes.
ROUNDS = 2
#: Samples of the 36 that a pair shares before its texts are compared.
AGREEING = 20
#: Most documents, and most total weight of them, that a cell takes before it is parted.
CELL = 2000
CELL_WEIGHT = 4_000_000
#: Documents that a cell compares with one other at a time.
_AT_ONCE = 32
RARE = 1000
BLOCK_PAIRS = 64
_DRAWS = 4096
_WIDE = 4096

_SKETCH = "id long, node binary, bands array<long>, samples array<short>, total double"
_SIGNED = pa.schema(
    [("id", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("samples", pa.list_(pa.int16())), ("total", pa.float64())]
)
_OPEN = pa.schema([("cell", pa.int64()), ("node", pa.binary())])
_LINK = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])


class Sampler:
    """Consistent weighted samples: equal (shingle, level) with probability near the similarity."""

    def __init__(self, count: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        gamma = -np.log(rng.random((2, _DRAWS)) * rng.random((2, _DRAWS)) + 1e-30)
        self.r = gamma[0].astype(np.float32)
        self.inverse = (1 / gamma[0]).astype(np.float32)
        self.log_c = np.log(gamma[1]).astype(np.float32)
        self.factors = rng.integers(0, 2**32, (2, count, 1), np.uint32) | np.uint32(1)

    def __call__(self, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        log_w = np.log(weights).astype(np.float32)
        best, sample = None, None
        for a in range(0, len(shingles), _WIDE):
            s = shingles[a : a + _WIDE]
            x = (s >> np.uint64(32)).astype(np.uint32) * self.factors[0]
            y = s.astype(np.uint32) * self.factors[1]
            i, beta = x >> np.uint32(20), (y & np.uint32(0xFFFFF)).astype(np.float32) * np.float32(2**-20)
            level = np.floor(log_w[a : a + _WIDE] * self.inverse[i] + beta)
            value = self.log_c[y >> np.uint32(20)] - self.r[i] * (level - beta + 1)
            at = value.argmin(axis=1)
            row = np.arange(len(at))
            least, key = value[row, at], mixed(s[at] + level[row, at].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            better = slice(None) if best is None else least < best
            if best is None:
                best, sample = least, key
            else:
                best[better], sample[better] = least[better], key[better]
        return sample


def shingle_weights(ws: list[bytes], common: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text, sorted, and their weights."""
    if not ws:
        return np.empty(0, np.uint64), np.empty(0)
    h = hashed(ws, len(ws))
    own = np.full(len(h), 2.0)
    if len(common):
        where = np.minimum(np.searchsorted(common, h), len(common) - 1)
        own = np.where(common[where] == h, scale[where], own)
    size = min(SHINGLE, len(h))
    total = np.r_[0.0, np.cumsum(own)]
    mean = (total[size:] - total[:-size]) / size
    shingles, first, counts = np.unique(rolling(h, size), return_index=True, return_counts=True)
    return shingles, mean[first] * counts


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    where = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    shared = np.minimum(a[1], b[1][where])[b[0][where] == a[0]].sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def _node(ws: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(ws)).digest()


def _packed_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, node, packed), texts compressed."""
    for batch in batches:
        for packed in packed_texts([batch]):
            nodes = pa.array([_node(words(t)) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([packed.column("id"), nodes, packed.column("packed")], names=["id", "node", "packed"])


def word_scale(source: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of the words in over a thousandth of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for _, texts in chunks(batch):
                each = [set(words(t)) for t in texts]
                h = hashed((w for ws in each for w in ws), sum(map(len, each)))
                word, df = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(word)), pa.array(df)], names=["word", "df"])

    n = source.count()
    rows = (
        source.select("text").mapInArrow(count, "word long, df long")
        .groupBy("word").agg(F.sum("df").alias("df"))
        .filter(F.col("df") * RARE > n).toPandas()
    )
    word = rows["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(word)
    scale = 1 + np.minimum(1, np.log(n / rows["df"].to_numpy(float)) / np.log(RARE)) if len(rows) else np.empty(0)
    return word[order], scale[order]


def _sketched(batches: Iterator[pa.RecordBatch], common: np.ndarray, scale: np.ndarray) -> Iterator[pa.RecordBatch]:
    sampler = Sampler(BANDS * ROWS)
    tags = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        for first, texts in chunks(batch):
            nodes, bands, short, totals = [], [], [], []
            for text in texts:
                ws = words(text)
                nodes.append(_node(ws))
                shingles, weights = shingle_weights(ws, common, scale)
                totals.append(float(weights.sum()))
                if not len(shingles):
                    bands.append([])
                    short.append([])
                    continue
                samples = sampler(shingles, weights).reshape(BANDS, ROWS)
                short.append(samples.astype(np.uint16).view(np.int16).ravel())
                key = tags
                for column in samples.T:
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
                bands.append(signed(key))
            yield batch_of(_SIGNED, id=batch.column("id").slice(first, len(texts)), node=nodes, bands=bands, samples=short, total=totals)


def _verified(batches: Iterator[pa.RecordBatch], common: np.ndarray, scale: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (b, block, kind): one text of kind 0, then those to compare with it."""
    opener = zstandard.ZstdDecompressor()
    at, pivot = None, None
    for batch in batches:
        found = []
        for b, block, node, packed in zip(*(batch.column(c).to_pylist() for c in ("b", "block", "node", "packed"))):
            ws = words(opener.decompress(packed).decode())
            if node == b:
                at, pivot = (b, block), shingle_weights(ws, common, scale)
            elif at == (b, block):
                similarity = weighted_jaccard(shingle_weights(ws, common, scale), pivot)
                if similarity >= least - 1e-9:
                    found.append((node, b, similarity))
        if found:
            yield batch_of(_LINK, **dict(zip(_LINK.names, zip(*found))))


def _cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole cells, from rows sorted by cell."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        cell = table["cell"].to_numpy()
        last = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
        held = table.slice(last)
        if last:
            yield table.slice(0, last)
    if held is not None and len(held):
        yield held


def _matrix(table: pa.Table, column: str, width: int) -> np.ndarray:
    return table[column].combine_chunks().flatten().to_numpy().reshape(len(table), width)


def _reach(cell: np.ndarray, total: np.ndarray, least: float) -> np.ndarray:
    """How many rows after each, in order of (cell, total), are near enough in weight."""
    # one ascending key for both: a log of a weight spans far less than 256
    place = np.r_[0, np.cumsum(cell[1:] != cell[:-1])] * 256.0 + np.log(total)
    return np.searchsorted(place, place - np.log(least) + 1e-6, "right") - 1 - np.arange(len(place))


def _candidates(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (cell, node) that have a candidate of another class whose first band is the cell's."""
    for table in _cells_of(batches):
        if len(table) < 2:
            continue
        cell, band = table["cell"].to_numpy(), table["band"].to_numpy()
        roots = table["root"].combine_chunks().dictionary_encode().indices.to_numpy()
        bands, samples = _matrix(table, "bands", BANDS), _matrix(table, "samples", BANDS * ROWS)
        found = np.zeros(len(table), bool)
        reach, step = _reach(cell, table["total"].to_numpy(), least), 1
        at = np.flatnonzero(reach >= 1)
        while len(at):
            i = at[(roots[at] != roots[at + step]) & ~(found[at] & found[at + step])]
            for k in range(0, len(i), 1 << 16):
                j = i[k : k + (1 << 16)]
                j = j[(samples[j] == samples[j + step]).sum(axis=1) >= AGREEING]
                j = j[(bands[j] == bands[j + step]).argmax(axis=1) >= band[j]]
                found[j] = found[j + step] = True
            step += 1
            at = at[reach[at] >= step]
        if found.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell[found]), table["node"].combine_chunks().filter(pa.array(found))], schema=_OPEN
            )


def _forest(nodes: list[bytes], roots: list[bytes], samples: np.ndarray, total: np.ndarray, sets: list, least: float) -> list[tuple]:
    """Links that join the classes of one cell; rows in ascending order of total.

    Documents of one class are not compared, so there are fewer links than documents.
    """
    sizes = np.array([len(x) for x, _ in sets])
    starts = np.r_[0, np.cumsum(sizes)]
    distinct, place = np.unique(np.concatenate([x for x, _ in sets]), return_inverse=True)
    weights = np.concatenate([w for _, w in sets])
    sums = np.add.reduceat(weights, starts[:-1])
    own = np.zeros(len(distinct))
    label = np.unique(np.array(roots, object), return_inverse=True)[1]
    reach = _reach(np.zeros(len(nodes)), total, least)
    links = []
    for i in np.flatnonzero(reach):
        left = np.arange(i + 1, i + 1 + reach[i])
        left = left[label[left] != label[i]]
        equal = (samples[left] == samples[i]).sum(axis=1)
        left = left[np.argsort(-equal, kind="stable")][: int((equal >= AGREEING).sum())]
        if not len(left):
            continue
        mine = slice(starts[i], starts[i + 1])
        own[place[mine]] = weights[mine]
        while len(left):
            some, left = left[:_AT_ONCE], left[_AT_ONCE:]
            at = np.concatenate([np.arange(starts[j], starts[j + 1]) for j in some])
            shared = np.add.reduceat(np.minimum(own[place[at]], weights[at]), np.r_[0, np.cumsum(sizes[some])[:-1]])
            similarity = shared / (sums[i] + sums[some] - shared)
            for j, value in zip(some, similarity):
                if value >= least - 1e-9 and label[j] != label[i]:
                    links.append((nodes[i], nodes[j], float(value)))
                    label[label == label[j]] = label[i]
            left = left[label[left] != label[i]]
        own[place[mine]] = 0
    return links


def _joined(batches: Iterator[pa.RecordBatch], common: np.ndarray, scale: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """Links of each cell; rows (cell, node, root, samples, total, packed) sorted by cell and total."""
    opener = zstandard.ZstdDecompressor()
    for table in _cells_of(batches):
        cell, samples, total = table["cell"].to_numpy(), _matrix(table, "samples", BANDS * ROWS), table["total"].to_numpy()
        borders = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
            rows = table.slice(a, b - a)
            sets = [shingle_weights(words(opener.decompress(p.as_py()).decode()), common, scale) for p in rows["packed"]]
            links = _forest(rows["node"].to_pylist(), rows["root"].to_pylist(), samples[a:b], total[a:b], sets, least)
            if links:
                yield batch_of(_LINK, **dict(zip(_LINK.names, zip(*links))))


def _cells(at: DataFrame, width: float, cell: int) -> DataFrame:
    """(cell, band, node, root, bands, samples, total): every two nodes of a bucket that can be near meet in a cell.

    A bucket that does not fit is parted by weight. A part is dealt to blocks, those of its
    largest class apart; every two blocks are a cell, except two of that class.
    """
    columns = ["node", "root", "bands", "samples", "total"]
    fits = (F.col("size") <= cell) & (F.col("weight") <= CELL_WEIGHT)
    small = at.filter(fits).select(F.col("bucket").alias("cell"), "band", *columns)
    bin_ = F.floor(F.log("total") / width)
    parts = at.filter(~fits).withColumn("bin", F.explode(F.array(bin_, bin_ + 1))).withColumn("part", F.xxhash64("bucket", "bin"))
    classes = parts.groupBy("part", "root").agg(F.count("*").alias("n"), F.sum("total").alias("weight"))
    blocks = classes.groupBy("part").agg(
        F.max(F.struct("n", "root", "weight")).alias("most"), F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("weight").alias("weight")
    ).filter("classes > 1")
    needed = lambda n, weight: F.ceil(F.greatest(n / cell, weight / CELL_WEIGHT, F.lit(1.0))).cast("long")
    blocks = blocks.select(
        "part", F.col("most.root").alias("largest"), needed(F.col("most.n"), F.col("most.weight")).alias("own_blocks"),
        needed(F.col("n") - F.col("most.n"), F.col("weight") - F.col("most.weight")).alias("blocks"),
    )
    parts = parts.join(blocks, "part").withColumn("inside", F.col("root") == F.col("largest"))
    parts = parts.withColumn(
        "own", F.expr("if(inside, blocks + pmod(xxhash64(node), own_blocks), pmod(xxhash64(node), blocks))")
    ).withColumn("other", F.explode(F.expr("sequence(0L, if(inside, blocks, blocks + own_blocks) - 1)"))).filter("own != other")
    low, high = F.least("own", "other"), F.greatest("own", "other")
    # every pair of a part counts there, whatever bands it shares
    return small.unionByName(parts.select(F.xxhash64("part", low, high).alias("cell"), F.lit(0).alias("band"), *columns))


def _agreeing(a: str, b: str):
    equal = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(equal, F.lit(0), lambda n, x: n + x)


def _crowded(keyed: DataFrame) -> DataFrame:
    """(node, band, key) to (node, bucket, size), for buckets of two nodes or more."""
    keyed = keyed.distinct()
    crowded = keyed.groupBy("band", "key").agg(F.count("*").alias("size")).filter("size > 1")
    return keyed.join(crowded, ["band", "key"]).select("node", "band", F.xxhash64("band", "key").alias("bucket"), "size")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, cell: int = CELL
) -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, kept.

    Classes are connected by links of weighted Jaccard similarity 0.8 or more and by
    equality of words; class_id is their smallest doc_id, whose row is kept (all rows
    with that id are, where ids repeat). NULL and empty texts are one class. The id must
    be an integer; rows without one are in no class of others unless their words are
    equal, and then are not kept. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    common, scale = word_scale(source)
    sketch = scratch.put(
        source.mapInArrow(lambda it: _sketched(it, common, scale), _SKETCH), "sketch"
    )
    banded = sketch.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = scratch.put(_crowded(banded), "band")
    # documents in the largest buckets are the most central and are compared first
    central = buckets.groupBy("node").agg(F.sum("size").alias("rank"))
    firsts = [F.first(c).alias(c) for c in ("bands", "samples", "total")]
    nodes = scratch.put(central.join(sketch.groupBy("node").agg(F.min("id").alias("id"), *firsts), "node"), "nodes")
    # the node travels with the text, which tells texts of one id apart without another worker for each task
    packed = source.mapInArrow(_packed_nodes, "id long, node binary, packed binary")
    texts = scratch.put(nodes.select("id", "node").join(packed, ["id", "node"]).select("node", "packed"), "texts")

    def compared(pairs: DataFrame) -> DataFrame:
        sizes = pairs.groupBy("b").count()
        blocks = F.greatest(F.lit(1), F.expr(f"count div {BLOCK_PAIRS}"))
        items = pairs.join(sizes, "b").withColumn("block", F.pmod(F.xxhash64("a"), blocks))
        items = items.select("b", "block", F.lit(1).alias("kind"), F.col("a").alias("node")).union(
            items.select("b", "block", F.lit(0).alias("kind"), F.col("b").alias("node")).distinct()
        )
        return (
            items.join(texts, "node")
            .repartition("b", "block")
            .sortWithinPartitions("b", "block", "kind")
            .select("b", "block", "node", "packed")
            .mapInArrow(lambda it: _verified(it, common, scale, similarity), "a binary, b binary, similarity double")
        )

    links, roots = None, None
    for turn in range(ROUNDS + 1):
        known = nodes.drop("id")
        if roots is None:
            known = known.withColumn("root", F.col("node"))
        else:
            known = known.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if turn < ROUNDS:
            order = F.xxhash64("node", F.lit(turn)) if turn else -F.col("rank")
            at = buckets.join(known.select("node", "rank", "root", "total", "samples"), "node")
            heads = at.groupBy("bucket").agg(
                F.min(F.struct(order.alias("o"), "node", "root", "total", "samples")).alias("h"),
                F.min("root").alias("low"), F.max("root").alias("high"),
            ).filter("low != high").select("bucket", F.col("h.node").alias("b"), *[F.col(f"h.{c}").alias(f"b_{c}") for c in ("root", "total", "samples")])
            like = F.least("total", "b_total") >= F.greatest("total", "b_total") * (similarity - 1e-6)
            like &= _agreeing("samples", "b_samples") >= AGREEING
            pairs = at.join(heads, "bucket").filter(F.col("root") != F.col("b_root")).filter(like).select(F.col("node").alias("a"), "b")
            pairs = scratch.put(pairs.distinct(), f"pairs{turn}")
            new = scratch.put(compared(pairs), f"links{turn}")
        else:
            at = buckets.join(known.select("node", "root", "total"), "node")
            open_ = at.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("total").alias("weight"))
            open_ = open_.filter("low != high").select("bucket", "weight")
            at = buckets.join(known.drop("rank"), "node").join(open_, "bucket")
            cells = _cells(at, -float(np.log(similarity - 1e-6)), cell)
            likely = cells.repartition("cell").sortWithinPartitions("cell", "total").mapInArrow(
                lambda it: _candidates(it, similarity - 1e-6), "cell long, node binary"
            )
            likely = scratch.put(likely, "likely").join(known.select("node", "root", "samples", "total"), "node").join(texts, "node")
            new = scratch.put(
                likely.select("cell", "node", "root", "samples", "total", "packed")
                .repartition("cell")
                .sortWithinPartitions("cell", "total")
                .mapInArrow(lambda it: _joined(it, common, scale, similarity), "a binary, b binary, similarity double"),
                f"links{turn}",
            )
        if new.isEmpty():
            continue
        links = new if links is None else links.union(new)
        roots = scratch.put(components(links.select("a", "b"), scratch, f"graph{turn}"), f"roots{turn}")
    member = sketch.select("id", "node")
    if roots is not None:
        member = member.join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("node"))
    member = scratch.put(member, "member")
    scratch.drop("sketch", "band", "texts")
    classes = member.groupBy("node").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return member.join(classes, "node").select(
        F.col("id").alias("doc_id"), "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept")
    )
