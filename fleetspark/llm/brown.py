"""Language-model scores from class-based bigrams, classes found by exchange clustering.

Tokens are lower-cased (A-Z) words and one end per text. The vocabulary is every word with
at least a millionth of all training tokens (so at most a million words, which travel to
the tasks). Its CORE most frequent words are put into classes by the exchange algorithm,
which moves words while the likelihood of the class bigrams rises. Every other word then
moves to the class of greatest gain, from the counts of the classes beside it that one
grouped pass collects; ROUNDS such passes follow one another, each over the classes that
the one before left. In a pass a word beside itself counts as lying in its old class. The
end is a class of its own, and so are all words too seldom for the vocabulary.

A token's probability is class given previous class (interpolated with the class's share)
times word given class: by counts in the vocabulary, (c + 1) / (n + v + 1) among the n
tokens and v types of seldom words, so that a word never seen has a probability too.
Counts cover all training texts; those of seldom words are joined by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from fleetspark.llm.base import Scratch, chunks, fold, hashed, signed

FOLDS, HELD_OUT = 7, 2
CORE, CLASSES = 500, 42
FREQUENT = 1_000_000
SWEEPS, ROUNDS = 8, 2
END = np.uint64(xxh3_64_intdigest(b" end"))  # no word holds a space
_BACK_OFF = 5.0
#: Words whose gains are worked out at a time, of at most 2 x CLASSES counts each.
_AT_ONCE = 500


def lowered(text: str) -> list[bytes]:
    return text.encode().lower().split()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in chunks(batch):
            ws = [w for t in texts for w in lowered(t)]
            word, n = np.unique(hashed(ws, len(ws)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[signed(word), signed(np.array([END]))]), pa.array(np.r_[n, len(texts)])], names=["word", "n"])


class Vocabulary(NamedTuple):
    """Sorted hashes of words and their counts; number 0 is the end, the last a seldom word."""

    words: np.ndarray
    counts: np.ndarray

    def numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and numbers of all words, and the number of words of each text."""
        split = [lowered(t) for t in texts]
        sizes = np.array([len(ws) for ws in split])
        h = hashed((w for ws in split for w in ws), int(sizes.sum()))
        if not len(self.words):
            return h, np.ones(len(h), np.int64), sizes
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return h, np.where(self.words[at] == h, at, len(self.words)) + 1, sizes


class Model(NamedTuple):
    """Class of every number, log10 of class steps, and log10 of word given class."""

    vocabulary: Vocabulary
    classes: np.ndarray
    steps: np.ndarray
    emission: np.ndarray


def phi(x):
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of items from their bigram counts.

    The first item stays alone in the first class, and the last item in the last.
    """
    total = pairs.sum(0) + pairs.sum(1)
    order = [i for i in np.argsort(-total, kind="stable") if 0 < i < len(pairs) - 1]
    own = np.zeros(len(pairs), np.int64)
    own[-1] = classes - 1
    for rank, i in enumerate(order):
        own[i] = 1 + rank % (classes - 2)
    member = np.eye(classes)[own]
    table = member.T @ pairs @ member
    after, before = pairs @ member, (member.T @ pairs).T  # by item: counts towards and from classes
    for _ in range(sweeps):
        moved = 0
        for i in order:
            if not total[i]:
                continue
            c, self_pairs = own[i], pairs[i, i]
            out, into = after[i].copy(), before[i].copy()
            out[c] -= self_pairs
            into[c] -= self_pairs
            base = table.copy()
            base[c] -= out
            base[:, c] -= into
            base[c, c] -= self_pairs
            rows, cols = base.sum(1), base.sum(0)
            # gain of putting the item into each class
            gain = (phi(base + out) - phi(base)).sum(1) + (phi(base.T + into) - phi(base.T)).sum(1)
            diag = np.diag(base)
            gain += phi(diag + out + into + self_pairs) - phi(diag + out) - phi(diag + into) + phi(diag)
            gain -= phi(rows + out.sum() + self_pairs) - phi(rows) + phi(cols + into.sum() + self_pairs) - phi(cols)
            gain[[0, -1]] = -np.inf
            d = int(np.argmax(gain))
            if d != c and gain[d] > gain[c] + 1e-9:
                own[i], moved = d, moved + 1
                after[:, c] -= pairs[:, i]
                after[:, d] += pairs[:, i]
                before[:, c] -= pairs[i]
                before[:, d] += pairs[i]
                table = base
                table[d] += out
                table[:, d] += into
                table[d, d] += self_pairs
        if not moved:
            break
    return own


def transition_scores(table: np.ndarray) -> np.ndarray:
    """log10 P(class | previous class) from the counts of class bigrams."""
    share = (table.sum(0) + 1) / (table.sum() + len(table))
    return np.log10((table + _BACK_OFF * share) / (table.sum(1, keepdims=True) + _BACK_OFF))


def best_classes(own: np.ndarray, owner: np.ndarray, cell: np.ndarray, n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Class of greatest gain for words of classes ``own``.

    ``n`` counts the class ``cell`` before word ``owner``, or from CLASSES on, after it;
    the owners ascend. What a word gave to its own class is taken out first.
    """
    k = len(table)
    after, side = cell >= k, cell % k
    here = np.where(after[:, None], table[:, side].T, table[side])
    away = np.zeros_like(here)
    away[np.arange(len(n)), own[owner]] = n
    here = np.maximum(here - away, 0)
    gain = np.zeros((len(own), k))
    np.add.at(gain, owner, phi(here + n[:, None]) - phi(here))
    for at, total in ((after, table.sum(1)), (~after, table.sum(0))):
        mass = np.bincount(owner[at], n[at], len(own))[:, None]
        rest = np.maximum(total - mass * np.eye(k)[own], 0)
        gain -= phi(rest + mass) - phi(rest)
    gain[:, [0, -1]] = -np.inf
    return gain.argmax(axis=1)


def fit(training: DataFrame, counts: DataFrame, tokens: int, scratch: Scratch) -> Model:
    """Classes and probabilities from all training texts and the counts (word, n) of their tokens.

    The driver holds the vocabulary (at most a million words) and one class for each.
    """
    is_word = F.col("word") != int(signed(np.array([END]))[0])
    often = counts.filter((F.col("n") * FREQUENT >= tokens) & is_word).toPandas()
    order = np.argsort(often["word"].to_numpy(np.int64).view(np.uint64))
    vocabulary = Vocabulary(often["word"].to_numpy(np.int64).view(np.uint64)[order], often["n"].to_numpy(np.int64)[order])
    size = len(order)

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch):
                _, number, sizes = vocabulary.numbered(texts)
                current = np.insert(number, np.cumsum(sizes), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([current.tobytes()], pa.binary())], names=["numbers"])

    # every sequence starts after an end and closes with one
    stored = scratch.put(training.mapInArrow(sequences, "numbers binary"), "sequences")

    def steps_of(batches: Iterator[pa.RecordBatch], of: np.ndarray, width: int, beside: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, np.int64)
        for batch in batches:
            for packed in batch.column("numbers"):
                number = np.frombuffer(packed.as_buffer(), np.int32)
                item = of[number]
                previous = np.r_[0, item[:-1]]
                total += np.bincount(previous * width + item, minlength=width * width)
                if beside is not None:
                    at = np.flatnonzero(beside[number])
                    word = number[at].astype(np.int64) * (2 * width)
                    key, n = np.unique(np.r_[word + previous[at], word + width + item[at + 1]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key // (2 * width)), pa.array(key % (2 * width)), pa.array(n)], names=["word", "cell", "n"])
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), -1)), pa.array(cell), pa.array(total[cell])], names=["word", "cell", "n"])

    def counted(of: np.ndarray, width: int, beside: np.ndarray | None = None) -> DataFrame:
        rows = stored.mapInArrow(lambda it: steps_of(it, of, width, beside), "word long, cell long, n long")
        return rows.groupBy("word", "cell").agg(F.sum("n").alias("n"))

    def square(rows: DataFrame, width: int) -> np.ndarray:
        found = rows.filter("word = -1").select("cell", "n").toPandas()
        flat = np.zeros(width * width)
        flat[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(float)
        return flat.reshape(width, width)

    core = np.lexsort((vocabulary.words, -vocabulary.counts))[:CORE] + 1
    item = np.full(size + 2, len(core) + 1)
    item[0], item[core] = 0, np.arange(1, len(core) + 1)
    of_item = exchange(square(counted(item, len(core) + 2), len(core) + 2))
    classes = of_item[item]
    moving = (item == len(core) + 1) & (np.arange(size + 2) <= size)
    for turn in range(ROUNDS if moving.any() else 0):
        rows = scratch.put(counted(classes, CLASSES, moving), f"beside{turn}")
        table = square(rows, CLASSES)

        def choose(batches: Iterator[pa.RecordBatch], classes=classes, table=table) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, len(batch), _AT_ONCE):
                    some = batch.slice(a, _AT_ONCE)
                    word, found = some.column("word").to_numpy(), some.column("found")
                    owner = np.repeat(np.arange(len(word)), found.value_lengths().to_numpy())
                    cell, n = (found.flatten().field(c).to_numpy() for c in ("cell", "n"))
                    best = best_classes(classes[word], owner, cell, n.astype(float), table)
                    yield pa.RecordBatch.from_arrays([some.column("word"), pa.array(best)], names=["word", "class"])

        # at most 2 x CLASSES cells a word
        by_word = rows.filter("word >= 0").groupBy("word").agg(F.collect_list(F.struct("cell", "n")).alias("found"))
        chosen = by_word.mapInArrow(choose, "word long, class long").toPandas()
        classes = classes.copy()
        classes[chosen["word"].to_numpy(np.int64)] = chosen["class"].to_numpy(np.int64)
    table = square(counted(classes, CLASSES), CLASSES)
    seldom = counts.filter((F.col("n") * FREQUENT < tokens) & is_word).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    weight = vocabulary.counts + 0.5
    inside = np.bincount(classes[1:-1], weight, CLASSES)
    emission = np.r_[0.0, np.log10(weight / inside[classes[1:-1]]), -np.log10(seldom[0] + seldom[1] + 1)]
    scratch.drop("sequences", *[f"beside{turn}" for turn in range(ROUNDS if moving.any() else 0)])
    return Model(vocabulary, classes, transition_scores(table), emission)


def class_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    NULL and empty texts are the end alone. Rows without an id are training rows. Rows
    may repeat. An empty table gives no rows; with nothing to learn from, every word is
    unknown. Columns other than the two named are not read.
    """
    scratch = Scratch(docs.sparkSession, "brown")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    source = source.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)))
    training = source.filter("not held_out").select("text")
    counts = scratch.put(training.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    vocabulary, classes, steps, emission = fit(training, counts, tokens, scratch)
    end = int(signed(np.array([END]))[0])
    end_count = np.log10(counts.filter(F.col("word") == end).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + 1)
    spread = np.log10(tokens + types + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch):
                h, number, sizes = vocabulary.numbered(texts)
                count = np.r_[0, vocabulary.counts, 0][number]
                text = np.repeat(np.arange(len(texts)), sizes)
                current = classes[np.insert(number, np.cumsum(sizes), 0)]
                add = lambda v, at=text: np.bincount(at, v, minlength=len(texts))
                log, moves = np.log10(count + 1.0), add(steps[np.r_[0, current[:-1]], current], np.repeat(np.arange(len(texts)), sizes + 1))
                away = np.flatnonzero(count == 0)
                cuts = np.searchsorted(away, np.cumsum(sizes))
                words, times = [], []
                for part in np.split(h[away], cuts[:-1]):
                    w, n = np.unique(part, return_counts=True)
                    words.append(signed(w))
                    times.append(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(texts)),
                        batch.column("held_out").slice(first, len(texts)),
                        pa.array(sizes + 1),
                        pa.array(add(count > 0).astype(np.int64) + int(end_count > 0)),
                        pa.array(add(log) + end_count - (sizes + 1) * spread),
                        pa.array(moves + add(emission[number])),
                        pa.array(words, pa.list_(pa.int64())),
                        pa.array(times, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "words", "times"],
                )

    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, words array<long>, times array<long>"
    rows = scratch.put(source.select("doc_id", "text", "held_out").mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id()), "rows")
    seldom = counts.filter((F.col("n") * FREQUENT < tokens) & (F.col("word") != end)).select("word", "n")
    away = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = scratch.put(
        away.join(seldom, "word").groupBy("row")
        .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log")),
        "found",
    )
    slim = scratch.put(rows.drop("words", "times"), "slim")
    scratch.drop("counts", "rows")
    more = F.coalesce("log", F.lit(0.0))
    return slim.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
