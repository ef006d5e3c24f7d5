"""What the operators share: tables in the shared folder, words, hashes, checksums.

A word is a run of bytes other than space, tab, newline, vertical tab, form feed and
carriage return, which is what ``bytes.split()`` yields.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

SPACES = r"[\x20\x09-\x0D]+"
CHUNK_CHARS = 2_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local session without the setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"/tmp/checkpoints/{context.applicationId}"


class Scratch:
    """Intermediate tables of one operator run, written to the shared folder.

    A written table ends the lineage, survives lost executors, and is computed once.
    Tables that no later step reads are dropped with ``drop``; small final ones stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def put(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.paths)}"
        self.paths[name] = path
        frame.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[name])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(of: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo the number of parts."""
    return F.crc32(of.cast("string").cast("binary")) % parts


def words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def hashed(items: Iterable[bytes], count: int) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, items), np.uint64, count)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every run of ``size`` values, by doubling."""
    if len(h) < size:
        return np.empty(0, np.uint64)
    done, width = None, 0
    power, span, factor = h, 1, _STEP
    left = size
    while left:
        if left & 1:
            if done is None:
                done, width = power, span
            else:
                n = len(h) - width - span + 1
                done = done[:n] * factor + power[width : width + n]
                width += span
        left >>= 1
        if left:
            n = len(h) - 2 * span + 1
            power = power[:n] * factor + power[span : span + n]
            factor = np.uint64(int(factor) ** 2 % 2**64)
            span *= 2
    return mixed(done)


def per_worker(key: tuple, make: Callable[[], object]):
    """The object of this key in this Python worker, made when a task first asks for it.

    Functions of this package travel by value, so their globals last no longer than a
    task; workers are used again, and keep what hangs on an importable module. A worker
    keeps the last object only, so the stages of a pipeline do not add up.
    """
    held = sys.modules.setdefault("_held_by_this_worker", types.ModuleType("_held_by_this_worker")).__dict__
    if held.get("key") != key:
        held.clear()
        held.update(object=make(), key=key)
    return held["object"]


def forget() -> None:
    """Let go of what ``per_worker`` keeps in this Python worker, in steps that need nothing kept."""
    if "_held_by_this_worker" in sys.modules:
        sys.modules["_held_by_this_worker"].__dict__.clear()


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Rows of a batch in slices of a bounded number of characters; one text is never cut."""
    start, size, held = 0, 0, []
    for i, text in enumerate(batch.column(column)):
        text = text.as_py() or ""
        if held and size + len(text) > most:
            yield start, held
            start, size, held = i, 0, []
        held.append(text)
        size += len(text)
    if held:
        yield start, held


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, packed): each text compressed, so that moving it is cheaper."""
    shrink = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [shrink.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], names=["id", "packed"])


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema
    )
