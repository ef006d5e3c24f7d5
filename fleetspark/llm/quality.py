"""Document quality: random-indexing word vectors, pooled, then a small calibrated network.

Every word is two tokens: its letters (hashed to 8,192 cores) and its shape, such as
``A!`` or ``a*`` (hashed to 512). Each token has a fixed sparse ternary index vector; a
token's word vector sums the index vectors of the two words on either side over the whole
corpus. Those sums are integers, so they do not depend on the order of addition. Tasks
send one table of fixed size each, added up in two rounds.

A document is the mean of its core vectors, the mean of its shape vectors, the mean
product of neighbouring core vectors, which shows repetition, and the logarithm of its
length. A network of one hidden layer is fitted on the driver to at most SAMPLE labelled
documents; its logits are divided by a temperature that fits a fifth of them held back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from fleetspark.llm.base import chunks, fold, per_worker, words

CORES, SHAPES, WIDTH, NEAR = 8192, 512, 32, 2
TOKENS = CORES + SHAPES
BLOCK = 128
SAMPLE = 20_000
FOLDS, HELD_OUT = 4, 2
KEEP_AT = 0.7
HIDDEN, EPOCHS, BATCH, RATE = 24, 40, 256, 0.005

CHUNK, PIECE = 250_000, 50_000
_EDGE = re.compile(r"^\W+|\W+$")
_LETTERS, _DIGITS, _MARKS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"([^\w\s])\1+")


def core_and_shape(text: str) -> tuple[str, str]:
    core = _EDGE.sub("", text).lower() or text
    shape = _LETTERS.sub(lambda run: "A" if run[0].isascii() and run[0].isupper() else "a", text)
    return core, _MARKS.sub(r"\1", _DIGITS.sub("0", shape))


_PLAIN = {a + b: xxh3_64_intdigest(a + b) % SHAPES for a in "Aa" for b in ["", *"!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"]}


class Tokens(dict):
    """Words to core and shape numbers, as one number; the cache is bounded.

    Letters alone, or with one mark behind them, which most words are, need no patterns.
    """

    def __missing__(self, word: bytes) -> int:
        text = word.decode()
        letters, mark = (text, "") if text.isalpha() else (text[:-1], text[-1])
        plain = _PLAIN.get(("A" if letters.isascii() and letters.isupper() else "a") + mark) if letters.isalpha() else None
        if plain is None:
            core, shape = core_and_shape(text)
            plain = xxh3_64_intdigest(shape) % SHAPES
        else:
            core = letters.lower()
        value = xxh3_64_intdigest(core) % CORES * SHAPES + plain
        if len(self) > 300_000:
            self.clear()
        self[word] = value
        return value


def _tokens(texts: list[str], known: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cores and shapes of all words of the texts in a row, and each text's number of words."""
    split = [words(t) for t in texts]
    sizes = np.array([len(ws) for ws in split])
    both = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
    return both // SHAPES, both % SHAPES + CORES, sizes


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(11)
    table = np.zeros((TOKENS, WIDTH), np.int8)
    for row in table:
        row[rng.choice(WIDTH, 4, replace=False)] = rng.choice([-1, 1], 4)
    return table


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, known, total = index_vectors(), per_worker(("tokens",), Tokens), np.zeros((TOKENS, WIDTH))
    for batch in batches:
        for _, texts in chunks(batch, most=CHUNK):
            core, shape, sizes = _tokens(texts, known)
            if not len(core):
                continue
            own = index[core] + index[shape]
            text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            near = np.zeros_like(own)  # at most 2 x 2 x NEAR either way
            for gap in range(1, NEAR + 1):
                same = (text[gap:] == text[:-gap])[:, None]
                near[gap:] += own[:-gap] * same
                near[:-gap] += own[gap:] * same
            # Rows of distinct tokens are added up first, so that each token is met once.
            for token in (core, shape):
                order = np.argsort(token.astype(np.int16), kind="stable")
                at = np.flatnonzero(np.r_[True, np.diff(token[order]) > 0])
                total[token[order[at]]] += np.add.reduceat(near[order], at, axis=0, dtype=np.int32)
    yield _blocks({b: total[b * BLOCK : (b + 1) * BLOCK] for b in range(TOKENS // BLOCK)}, TaskContext.get().partitionId())


def _blocks(sums: dict[int, np.ndarray], salt: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([salt] * len(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
        names=["block", "salt", "sums"],
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
            part = np.frombuffer(raw)
            sums[block] = sums[block] + part if block in sums else part
    if sums:
        yield _blocks(sums, 0)


def word_vectors(source: DataFrame) -> np.ndarray:
    """Unit vectors of all tokens from the whole corpus; a table of fixed size."""
    schema = "block int, salt int, sums binary"
    rows = (
        source.select("text").mapInArrow(_contexts, schema)
        .withColumn("salt", F.col("salt") % 32)
        .repartition("block", "salt").mapInArrow(_added, schema)
        .repartition("block").mapInArrow(_added, schema)
        .collect()
    )
    table = np.zeros((TOKENS // BLOCK, BLOCK * WIDTH))
    for row in rows:
        table[row["block"]] += np.frombuffer(row["sums"])
    table = table.reshape(TOKENS, WIDTH)
    table = np.sign(table) * np.log1p(np.abs(table))
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray, known: Tokens) -> np.ndarray:
    """One row of 3 x WIDTH + 1 numbers per text; zeros for a text without words.

    A text is taken in pieces of PIECE words, whatever its length.
    """
    core, shape, sizes = _tokens(texts, known)
    out = np.zeros((len(texts), 3 * WIDTH + 1), np.float32)
    starts = np.cumsum(sizes) - sizes
    for i in np.flatnonzero(sizes).tolist():
        a, end = int(starts[i]), int(starts[i] + sizes[i])
        sums = np.zeros((3, WIDTH))
        sums[1] = np.bincount(shape[a:end] - CORES, minlength=SHAPES) @ vectors[CORES:]
        for b in range(a, end, PIECE):
            v = vectors[core[max(a, b - 1) : min(end, b + PIECE)]]  # and the word before, for its product
            sums[2] += np.einsum("ij,ij->j", v[:-1], v[1:])
            sums[0] += v[b > a :].sum(0)
        out[i, :-1] = (sums / sizes[i]).ravel()
        out[i, -1] = np.log1p(sizes[i])
    return out


@dataclass
class Network:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2)[:, 0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(float) / self.temperature, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, seed: int = 5) -> Network:
    """Adam on log loss; without two classes to tell apart the score is their share, smoothed."""
    rng = np.random.default_rng(seed)
    wide = x.shape[1]
    net = Network(vectors, np.zeros(wide), np.ones(wide), [np.zeros((wide, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.zeros(1)], 1.0)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        net.layers[3][:] = np.log(share / (1 - share))
        return net
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    net.mean, net.scale = x[used].mean(0), x[used].std(0) + 1e-3
    net.layers = [rng.normal(0, wide**-0.5, (wide, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
    inputs = (x - net.mean) / net.scale
    first, second, step = [np.zeros_like(p) for p in net.layers], [np.zeros_like(p) for p in net.layers], 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(used), max(1, len(used) // BATCH)):
            w1, b1, w2, b2 = net.layers
            hidden = np.maximum(inputs[rows] @ w1 + b1, 0)
            off = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -50, 50))) - y[rows, None]) / len(rows)
            back = off @ w2.T * (hidden > 0)
            step += 1
            for i, grad in enumerate((inputs[rows].T @ back + 1e-4 * w1, back.sum(0), hidden.T @ off + 1e-4 * w2, off.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad**2
                net.layers[i] = net.layers[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    if len(held):
        z = net.logits(x[held])
        loss = lambda t: np.mean(np.logaddexp(0, z / t) - y[held] * z / t)
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Learn from documents (doc_id, text) and labels (doc_id, quality).

    Labels of the held-out fold are never read. At most ``sample`` labelled ids and as
    many rows of theirs are used, chosen by hash; of repeated labels the mean counts.
    Vectors come from all documents.
    """
    source = docs.select("doc_id", "text")
    vectors = word_vectors(source)
    picked = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_worker(("tokens",), Tokens)
        for batch in batches:
            for first, texts in chunks(batch, most=CHUNK):
                x = pooled(texts, vectors, known)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in x], pa.binary()), batch.column("good").slice(first, len(texts)), batch.column("doc_id").slice(first, len(texts))],
                    names=["x", "good", "doc_id"],
                )

    rows = source.join(F.broadcast(picked), "doc_id").select("text", "good", "doc_id").mapInArrow(features, "x binary, good int, doc_id long")
    rows = rows.orderBy(F.xxhash64("doc_id", "x"), "doc_id", "x").limit(sample).toPandas()  # rows, not ids, are bounded
    rows = rows.sort_values(["doc_id", "x"])  # the order of arrival must not matter
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, 3 * WIDTH + 1)
    return train(x, rows["good"].to_numpy(float), vectors)


def scored(docs: DataFrame, network: Network, out: str = "score") -> DataFrame:
    """All columns of the documents and a score from 0 to 1; NULL and empty texts get one too."""
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_worker(("tokens",), Tokens)
        for batch in batches:
            score = [network(pooled(texts, network.vectors, known)) for _, texts in chunks(batch, most=CHUNK)]
            column = pa.array(np.concatenate(score) if score else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, `{out}` double")


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (score of 0.7 or more).

    A document without an id counts as not held out. An empty table gives no rows;
    without usable labels every score is 0.5. Columns other than doc_id and text are
    not read.
    """
    source = docs.select("doc_id", "text")
    result = scored(source, fit(source, labels, sample))
    return result.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= KEEP_AT).cast("int").alias("predicted"),
    )
