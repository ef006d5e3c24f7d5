"""Packing token ids into sequences of a fixed capacity by harmonic classes.

Class k holds pieces of at most capacity // k tokens (and more than the next class's
slot), and every sequence of class k takes exactly k pieces. A document is cut so that
each piece nearly fills its slot: whole sequences first, then the largest slot that fits,
until what is left wastes under two percent of a sequence or is short. The cut depends
on the document's length alone, so texts are tokenised once and only small rows move.

Pieces are ranked within their class over shards of bounded size plus a table of shard
totals, so no class is gathered, and any worker can number its shard alone. The pieces
of each class's last, unfilled sequence (fewer than classes squared over two in all,
whatever the input) are placed first-fit by decreasing length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspark.llm.base import Scratch, chunks, per_worker

CAPACITY = 2048
CLASSES = 128
SHORT = 64
WASTE = 0.02
END_ID = 1
SHARD_ROWS = 100_000
CACHE_BYTES = 160 << 20

# A word that ends in a letter and then punctuation: both parts are tokenised apart.
_TAIL = b".,!?;:*$&%#|"
_ACCENTED = re.compile(rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]\Z")


class Known(dict):
    """Ids by word; a word that is not there yet gets a place in ``new`` that is filled later."""

    def __init__(self):
        self.new: dict[bytes, bytearray] = {}

    def __missing__(self, word: bytes) -> bytearray:
        return self.new.setdefault(word, bytearray())


class WordIds:
    """Ids of lower-cased words by a tokenizer that drops white space, with a bounded cache.

    Such a tokenizer never joins across white space, so a text's ids are its words' ids
    in a row. New words are encoded many at a time: letters alone, each one piece whose last
    id ends a word, with spaces between, all others parted by a special token. Words of a to z
    are what the tokenizer's own splitting leaves as they are, so its model gets them at once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.mark = "<|endoftext|>"
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.known = Known()
        self.held = 0

    def _cut(self, group: list[bytes], ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> None:
        raw = ids.tobytes()
        self.known.update((w, raw[a:b]) for w, a, b in zip(group, (4 * starts).tolist(), (4 * stops).tolist(), strict=True))

    def _encode(self, new: list[bytes]) -> None:
        apart, plain, letters = [], [], []
        for w in new:
            if w.isalpha() and w.islower():
                plain.append(w)
            elif b"<|" not in w:
                (letters if w.decode().isalpha() else apart).append(w)
        for tokenizer, some in ((self.plain, plain), (self.tokenizer, letters)):
            groups = [some[i : i + 256] for i in range(0, len(some), 256)]
            joined = [b" ".join(g).decode() for g in groups]
            for group, got in zip(groups, tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
                ids = np.array(got.ids, np.uint32)
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) == len(group):  # every word ends at least once, so each has ended once
                    self._cut(group, ids, np.r_[0, stops[:-1]], stops)
                else:
                    apart += group
        groups = [apart[i : i + 256] for i in range(0, len(apart), 256)]
        joined = [self.mark.join(w.decode() for w in g) for g in groups]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(got.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id)
            self._cut(group, ids, np.r_[0, cuts + 1], np.r_[cuts, len(ids)])
        for w in new:
            if b"<|" in w:
                got = self.tokenizer.encode(w.decode(), add_special_tokens=False)
                self.known[w] = np.array(got.ids, np.uint32).tobytes()

    def learn(self, seen: set[bytes]) -> None:
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        before = len(self.known)
        new = [w for w in seen if w not in self.known]
        parts, some = {}, set()
        for w in new:
            head = w.rstrip(_TAIL)
            if len(head) < len(w) and (head[-1:].islower() or _ACCENTED.search(head)) and b"<|" not in w:
                parts[w] = pair = head, w[len(head) :]
                some.update(pair)
            else:
                some.add(w)
        self._encode([w for w in some if w not in self.known])
        get = self.known.get
        self.known.update([(w, get(a) + get(b)) for w, (a, b) in parts.items()])
        self.held += 170 * (len(self.known) - before) + 2 * sum(map(len, new))  # with the objects' own size

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        split = [t.encode().lower().split() for t in texts]
        found = [list(map(self.known.__getitem__, ws)) for ws in split]
        new, self.known.new = self.known.new, {}
        self.learn(set(new))
        for w, place in new.items():
            place += self.known.get(w)
        for ids in found:
            yield b"".join(ids)


def cut(tokens: int, capacity: int = CAPACITY, classes: int = CLASSES) -> list[int]:
    """Lengths of the pieces of a document of so many tokens."""
    pieces = [capacity] * (tokens // capacity)
    left = tokens % capacity
    while left:
        k = min(classes, capacity // left)
        if left < SHORT or k * (capacity // k - left) <= WASTE * capacity:
            pieces.append(left)
            break
        pieces.append(capacity // (k + 1))
        left -= pieces[-1]
    return pieces


_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, class int"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """(doc_id, text) to one row per piece, with the checksum of its ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = per_worker(("packing", tokenizer_path), lambda: WordIds(tokenizer_path))
        end = np.array([END_ID], np.uint32).tobytes()
        for batch in batches:
            for first, texts in chunks(batch, most=500_000):
                rows, found = [], []
                for i, raw in enumerate(ids_of.texts(texts)):
                    raw += end
                    total, start = len(raw) // 4, 0
                    for length in cut(total, capacity, classes):
                        found.append((start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), total, min(classes, capacity // length)))
                        rows.append(first + i)
                        start += length
                columns = [pa.array(c, t) for c, t in zip(zip(*found), [pa.int64()] * 4 + [pa.int32()])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows)), *columns],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_PIECE}")


def _first_fit(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    frame = frame.sort_values(["length", "n"], ascending=[False, True])
    fill: list[int] = []
    bins, offsets = [], []
    for length in frame["length"]:
        at = next((i for i, used in enumerate(fill) if used + length <= capacity), len(fill))
        if at == len(fill):
            fill.append(0)
        bins.append(at)
        offsets.append(fill[at])
        fill[at] += length
    return frame.assign(bin=np.array(bins, "int64"), offset=np.array(offsets, "int64"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids and then the end id; NULL and empty texts are the end id
    alone. Repeated rows are packed as often as they occur. An empty table gives no
    pieces. Only doc_id and text are read; further columns do no harm.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.put(
        token_pieces(docs, tokenizer_path, capacity, classes).withColumn("n", F.monotonically_increasing_id()), "pieces"
    )
    per_class = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}
    shards = max(1, -(-sum(per_class.values()) // SHARD_ROWS))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("n"), F.lit(shards)))
    whole, base, sequences = {}, {}, 0
    for k in sorted(per_class):
        whole[k], base[k] = per_class[k] // k, sequences
        sequences += whole[k]
    table = docs.sparkSession.createDataFrame(
        [(k, whole[k] * k, base[k]) for k in sorted(per_class)], "class int, whole_pieces long, first_sequence long"
    )
    before = Window.partitionBy("class").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shard_base = (
        pieces.groupBy("class", "shard").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    )
    own = Window.partitionBy("class", "shard").orderBy("n")
    ranked = (
        pieces.withColumn("rank", F.row_number().over(own) - 1)
        .join(shard_base, ["class", "shard"])
        .withColumn("rank", F.col("rank") + F.col("before"))
        .join(F.broadcast(table), "class")
    )
    ranked = scratch.put(ranked.drop("shard", "before"), "ranked")
    scratch.drop("pieces")
    within = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    full = (
        ranked.filter("rank < whole_pieces")
        .withColumn("sequence_id", F.expr("first_sequence + rank div class"))
        .withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))
    )
    rest = ranked.filter("rank >= whole_pieces").drop("rank", "whole_pieces", "first_sequence", "class")
    kind = rest.schema["doc_id"].dataType.simpleString()
    rest = (
        rest.withColumn("few", F.lit(0))
        .groupBy("few")
        .applyInPandas(
            lambda frame: _first_fit(frame.drop(columns="few"), capacity),
            f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, n long, bin long, offset long",
        )
        .withColumn("sequence_id", F.col("bin") + sequences)
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return full.select(*columns).unionByName(rest.select(*columns))
