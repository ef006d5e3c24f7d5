"""Removal of repeated word runs: seed on winnowed anchors, extend both ways, keep the rest.

A window is a run of ``length`` consecutive words. Its anchor is the run of ``seed``
words inside it with the smallest hash (the leftmost of equals), so equal windows have
equal anchors at the same place, and one document has few anchors.

1. Seed: anchors of all documents are aggregated; those found in two texts, or twice in
   one, are candidates. Identical texts count once here, so copies cost nothing further.
2. Extend: around each candidate the text yields the hashes of the windows that have it
   as anchor, that is every extension to the left and right up to the full length. They
   travel as one row per anchor; equal (anchor, place, window hash) triples are matches.
3. The windows that match cover maximal repeats; covered words are removed.

An anchor at more than HOT places is matched by aggregation over its distinct spans, counted
inside the map tasks; others are matched in sorted streams. No pairs are formed. A frequent
anchor's span counts as repeated in its text unless the aggregation found it once: only the
spans found once are sent back to their texts.
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

LENGTH = 35
SEED = 6
HOT = 5_000

_TEXT = pa.schema(
    [("id", pa.int64()), ("given", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("sha", pa.binary()),
     ("anchors", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]
)
_SPAN = pa.schema(
    [("anchor", pa.int64()), ("frequent", pa.bool_()), ("text_key", pa.int64()), ("at", pa.int32()),
     ("place", pa.int32()), ("size", pa.int32()), ("windows", pa.binary())]
)
_MATCH = pa.schema([("text_key", pa.int64()), ("at", pa.int32()), ("mask", pa.int64())])


def _key(ws: list[bytes]) -> int:
    return int.from_bytes(hashlib.md5(b" ".join(ws)).digest()[:8], "little", signed=True)


def _windows(split: list[list[bytes]], length: int, seed: int):
    """Per text (or None where too short): anchor position of every window, seeds, hashes of windows."""
    sizes = [len(ws) for ws in split]
    h = hashed((w for ws in split for w in ws), sum(sizes))
    seeds, spans = rolling(h, seed), rolling(h, length)
    ends = np.cumsum(sizes)
    choices = length - seed + 1
    for size, end in zip(sizes, ends):
        start, count = end - size, size - length + 1
        if count <= 0:
            yield None
            continue
        own = seeds[start : end - seed + 1]
        anchor = np.lib.stride_tricks.sliding_window_view(own, choices).argmin(axis=1) + np.arange(count)
        yield anchor, own, spans[start : start + count]


def _anchored(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        for first, texts in chunks(batch):
            split = [words(t) for t in texts]
            anchors, times = [], []
            for got in _windows(split, length, seed):
                if got is None:
                    anchors.append([]), times.append([])
                    continue
                found, counts = np.unique(got[1][np.unique(got[0])], return_counts=True)
                anchors.append(signed(found)), times.append(counts)
            yield batch_of(
                _TEXT,
                id=batch.column("id").slice(first, len(texts)),
                given=batch.column("given").slice(first, len(texts)),
                text_key=[_key(ws) for ws in split],
                n_words=[len(ws) for ws in split],
                sha=[hashlib.sha256(b" ".join(ws)).digest() for ws in split],
                anchors=anchors,
                times=times,
            )


def _spanned(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    opener = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for packed, key, listed in zip(*(batch.column(c).to_pylist() for c in ("packed", "text_key", "listed"))):
            ws = words(opener.decompress(packed).decode())
            if _key(ws) != key:  # another text under the same id
                continue
            listed.sort(key=lambda x: x["anchor"])
            wanted = np.array([x["anchor"] for x in listed], np.int64)
            anchor, own, spans = next(_windows([ws], length, seed))
            starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            ends = np.r_[starts[1:], len(anchor)]
            seeds = signed(own)[anchor[starts]]
            where = np.minimum(np.searchsorted(wanted, seeds), len(wanted) - 1)
            for j in np.flatnonzero(wanted[where] == seeds):
                a, b = starts[j], ends[j]
                rows.append((seeds[j], listed[where[j]]["frequent"], key, a, anchor[a] - a, b - a, spans[a:b].tobytes()))
            if len(rows) > 5000:
                yield batch_of(_SPAN, **dict(zip(_SPAN.names, zip(*rows))))
                rows = []
        if rows:
            yield batch_of(_SPAN, **dict(zip(_SPAN.names, zip(*rows))))


def _matches(anchor, text_key, at, place, windows) -> pa.RecordBatch | None:
    """Spans of whole anchors to masks of their repeated windows."""
    counts = np.fromiter((len(w) // 8 for w in windows), np.int64, len(windows))
    starts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    step = np.arange(len(owner)) - starts[owner]
    spans = np.frombuffer(b"".join(windows), np.uint64)
    where = mixed(anchor.view(np.uint64)[owner] + (place[owner] - step).astype(np.uint64))
    order = np.lexsort((spans, where))
    same = (spans[order][1:] == spans[order][:-1]) & (where[order][1:] == where[order][:-1])
    found = np.zeros(len(owner), np.int64)
    found[order] = np.r_[same, False] | np.r_[False, same]
    masks = np.add.reduceat(found << step, starts)
    hit = np.flatnonzero(masks)
    if len(hit):
        return batch_of(_MATCH, text_key=text_key[hit], at=at[hit].astype(np.int32), mask=masks[hit])


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans sorted by anchor; the last anchor of a batch waits for its other rows."""
    held: list[pa.RecordBatch] = []

    def flush(table: pa.Table) -> pa.RecordBatch | None:
        take = {c: table.column(c).to_numpy() for c in ("anchor", "text_key", "at", "place")}
        return _matches(windows=table.column("windows").to_pylist(), **take) if table.num_rows else None

    for batch in batches:
        if not batch.num_rows:
            continue
        anchors = batch.column("anchor").to_numpy()
        cut = int(np.searchsorted(anchors, anchors[-1]))
        if cut or (held and held[-1].column("anchor")[0].as_py() != anchors[0]):
            if got := flush(pa.Table.from_batches([*held, batch.slice(0, cut)])):
                yield got
            held = []
        held.append(batch.slice(cut))
    if held and (got := flush(pa.Table.from_batches(held))):
        yield got


def _kept(batches: Iterator[pa.RecordBatch], length: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    opener = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for packed, key, spans in zip(*(batch.column(c).to_pylist() for c in ("packed", "text_key", "spans"))):
            ws = words(opener.decompress(packed).decode())
            change = np.zeros(len(ws) + 1, np.int64)
            told = {span["at"] for span in spans if not span["presumed"]}
            for span in spans:
                at, mask = span["at"], span["mask"]
                if span["presumed"] and at in told:
                    continue
                p = at + np.array([b for b in range(mask.bit_length()) if mask >> b & 1], np.int64)
                np.add.at(change, p, 1)
                np.add.at(change, p + length, -1)
            stay = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
            if len(stay) == len(ws):
                continue
            kept = b" ".join([ws[i] for i in stay])
            out.append((key, len(ws) - len(stay), hashlib.sha256(kept).digest(), kept.decode()))
        if out:
            yield batch_of(schema, **dict(zip(["text_key", "n_removed", "sha", "kept_text"], zip(*out))))


def repeated_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED,
    hot: int = HOT, with_text: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (and kept_text).

    A word goes when a window of ``length`` words covers it whose words also start
    anywhere else, in the same or another row; windows are those of the input. Rows with
    NULL ids are treated like all others, and so are different texts of one id. NULL and
    empty texts have no words; texts shorter than a window lose none. Repeated rows are
    copies of each other. An empty table gives no rows; further columns are not read.
    kept_text is NULL where nothing was removed, so that the source's text can serve.
    The id must be an integer. Masks hold up to 63 windows per anchor, so
    length - seed must be at most 62.
    """
    if not 0 < length - seed <= 62:
        raise ValueError("length must exceed seed by 1 to 62 words")
    scratch = Scratch(docs.sparkSession, "substring")
    given = F.col(id_col).cast("long")
    # A row without an id is found again by its text.
    instead = -F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(1 << 62)) - 1
    source = docs.select(F.coalesce(given, instead).alias("id"), given.alias("given"), F.col(text_col).alias("text"))
    texts = scratch.put(
        source.mapInArrow(
            lambda it: _anchored(it, length, seed),
            "id long, given long, text_key long, n_words long, sha binary, anchors array<long>, times array<long>",
        ),
        "texts",
    )
    listed = texts.select("id", "text_key", F.explode(F.arrays_zip("anchors", "times")).alias("x")).select(
        "id", "text_key", F.col("x.anchors").alias("anchor"), F.col("x.times").alias("times")
    )
    # one row per anchor found in two different texts, or twice in one
    shared = (
        listed.groupBy("anchor")
        .agg(F.min("text_key").alias("low"), F.max("text_key").alias("high"), F.max("times").alias("most"), F.sum("times").alias("places"))
        .filter("low != high or most > 1")
        .select("anchor", (F.col("places") > hot).alias("frequent"))
    )
    wanted = scratch.put(
        listed.drop("times").join(shared, "anchor")
        .groupBy("text_key")
        .agg(F.min("id").alias("id"), F.collect_set(F.struct("anchor", "frequent")).alias("listed")),
        "wanted",
    )
    packed = source.select("id", "text").mapInArrow(packed_texts, "id long, packed binary")
    spoken = scratch.put(wanted.join(packed, "id"), "spoken")
    spans = scratch.put(
        spoken.select("packed", "text_key", "listed").mapInArrow(
            lambda it: _spanned(it, length, seed),
            "anchor long, frequent boolean, text_key long, at int, place int, size int, windows binary",
        ),
        "spans",
    )
    cold = (
        spans.filter("not frequent")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_matched, "text_key long, at int, mask long")
    )
    # Spans of frequent anchors are told apart once; a span found twice repeats in all its
    # windows, and only the windows of the others, eight bytes each, are looked for. The least
    # text and place are those of the span where it was found once.
    often = spans.filter("frequent")
    shares = scratch.put(
        often.groupBy("anchor", "place", "windows")
        .agg(F.count("*").alias("n"), F.min("text_key").alias("text_key"), F.min("at").alias("at"), F.first("size").alias("size")),
        "shares",
    )
    each = shares.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("size") - 1))).select(
        "anchor", "step", "n", "text_key", "at", (F.col("place") - F.col("step")).alias("before"),
        F.expr("substring(windows, step * 8 + 1, 8)").alias("window"),
    )
    again = scratch.put(each.groupBy("anchor", "before", "window").agg(F.sum("n").alias("n")).filter("n > 1").drop("n"), "again")
    single = (
        each.filter("n = 1").join(again, ["anchor", "before", "window"])
        .groupBy("text_key", "at").agg(F.sum(F.expr("shiftleft(1L, step)")).alias("mask"))
    )
    alone = shares.filter("n = 1").select("text_key", "at", F.lit(0).cast("long").alias("mask"))
    presumed = often.select("text_key", "at", F.expr("shiftleft(1L, size) - 1").alias("mask"))
    marks = cold.unionByName(single).unionByName(alone).withColumn("presumed", F.lit(False))
    found = (
        marks.unionByName(presumed.withColumn("presumed", F.lit(True)))
        .groupBy("text_key").agg(F.collect_list(F.struct("at", "mask", "presumed")).alias("spans"))
    )
    schema = pa.schema([("text_key", pa.int64()), ("n_removed", pa.int64()), ("sha", pa.binary()), ("kept_text", pa.string())])
    cut = found.join(spoken.select("text_key", "id", "packed"), "text_key").select("packed", "text_key", "spans")
    cut = cut.mapInArrow(
        lambda it: _kept(it, length, schema), "text_key long, n_removed long, sha binary, kept_text string"
    )
    cut = scratch.put(cut if with_text else cut.drop("kept_text"), "cut")
    rows = scratch.put(texts.select("given", "text_key", "n_words", "sha"), "rows")
    scratch.drop("texts", "wanted", "spoken", "spans")
    copies = rows.groupBy(F.col("sha").alias("text_sha")).agg((F.count("*") > 1).alias("copied"))
    gone = F.col("copied") & (F.col("n_words") >= length)
    removed = F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    kept = F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.coalesce("cut.sha", "rows.sha"))))
    columns = [F.col("given").alias("doc_id"), "n_words", removed.cast("long").alias("n_removed"), kept.alias("kept_sha256")]
    if with_text:
        columns.append(F.when(gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    joined = (
        rows.alias("rows").join(copies, F.col("rows.sha") == F.col("text_sha")).join(cut.alias("cut"), "text_key", "left")
    )
    return joined.select(*columns, "text_key") if with_text else joined.select(*columns)
