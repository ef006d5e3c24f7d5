"""Quality rules: counts per document, and lines marked content or boilerplate by a CRF.

A linear-chain conditional random field scores each line from surface features and each
change of mark; Viterbi decoding marks the lines, and the share of characters in content
lines decides. It is fitted on the driver to at most SAMPLE labelled documents, whose
lines take the document's quality as their mark, with at most LINES lines of each; rows
of the whole table are marked over all their lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.base import chunks, hashed, rolling, words

FEW_WORDS, REPEATED_PERCENT, RUN = 20, 30, 8
SAMPLE, LINES = 2000, 256
SHARE = 0.5
SYMBOLS = "#*$%&|<>"
FEATURES = 11
_SPACE = " \t\n\r\x0b\x0c"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGIT, _MARK = b"0123456789", b"!?*#$%&|<>=_~"


def line_features(lines: list[str]) -> np.ndarray:
    """FEATURES numbers for every line of one text, in order."""
    seen: set[str] = set()
    rows = []
    for line in lines:
        raw = line.encode()
        ws = raw.split()
        n, count = len(raw) or 1, len(ws) or 1
        upper, lower = n - len(raw.translate(None, _UPPER)), n - len(raw.translate(None, _LOWER))
        rows.append(
            (
                1.0,
                min(len(ws), 60) / 60,
                upper / (upper + lower + 1),
                4 * (n - len(raw.translate(None, _MARK))) / n,
                4 * (n - len(raw.translate(None, _DIGIT))) / n,
                2 * raw.count(b"|") / count,
                2 * raw.count(b"!") / count,
                1 - len(set(ws)) / count,
                float(raw.endswith((b".", b"!", b"?"))),
                float(bool(ws) and line in seen),
                float(not ws),
            )
        )
        if ws:
            seen.add(line)
    return np.array(rows).reshape(-1, FEATURES)


def viterbi(emission: list[float], step: list[list[float]]) -> list[int]:
    """Best marks (1 content) where content scores ``emission`` and boilerplate 0."""
    low, high, back = 0.0, emission[0], []
    for e in emission[1:]:
        a, b = low + step[0][0], high + step[1][0]
        c, d = low + step[0][1], high + step[1][1]
        back.append((b > a, d >= c))
        low, high = max(a, b), max(c, d) + e
    mark = int(high >= low)
    marks = [mark]
    for choice in reversed(back):
        mark = int(choice[mark])
        marks.append(mark)
    return marks[::-1]


def train(documents: list[tuple[np.ndarray, int]], rounds: int = 150, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and 2 x 2 step scores by gradient ascent on the conditional likelihood."""
    weights, step = np.zeros(FEATURES), np.zeros((2, 2))
    weights[0] = 1.0
    documents = [d for d in documents if len(d[0])]
    if len({y for _, y in documents}) < 2:
        return weights, step
    longest = max(len(x) for x, _ in documents)
    x = np.zeros((len(documents), longest, FEATURES))
    length = np.array([len(d[0]) for d in documents])
    y = np.array([d[1] for d in documents])
    for i, (rows, _) in enumerate(documents):
        x[i, : len(rows)] = rows
    live = np.arange(longest)[None] < length[:, None]
    total = live.sum()
    moments = [np.zeros_like(weights), np.zeros_like(step), np.zeros_like(weights), np.zeros_like(step)]
    for turn in range(1, rounds + 1):
        e = np.zeros((len(documents), longest, 2))
        e[..., 1] = x @ weights
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.logaddexp(*(alpha[:, t - 1, [k], None] + step[k] for k in (0, 1)))[:, 0] + e[:, t]
        for t in range(longest - 2, -1, -1):
            ahead = e[:, t + 1] + beta[:, t + 1]
            beta[:, t] = np.where(live[:, [t + 1]], np.logaddexp(step[:, 0] + ahead[:, [0]], step[:, 1] + ahead[:, [1]]), 0)
        norm = np.logaddexp(alpha[:, 0, 0] + beta[:, 0, 0], alpha[:, 0, 1] + beta[:, 0, 1])
        content = np.exp(alpha[..., 1] + beta[..., 1] - norm[:, None]) * live
        grad_w = np.einsum("dt,dtf->f", y[:, None] * live - content, x) / total - 1e-4 * weights
        both = alpha[:, :-1, :, None] + step + (e + beta)[:, 1:, None, :] - norm[:, None, None, None]
        expected = (np.exp(np.minimum(both, 0)) * live[:, 1:, None, None]).sum((0, 1))
        stays = live[:, 1:].sum(1)
        grad_s = (np.diag([stays[y == 0].sum(), stays[y == 1].sum()]) - expected) / total - 1e-2 * step
        for i, grad in enumerate((grad_w, grad_s)):
            moments[i] = 0.9 * moments[i] + 0.1 * grad
            moments[i + 2] = 0.999 * moments[i + 2] + 0.001 * grad**2
            change = rate * (moments[i] / (1 - 0.9**turn)) / (np.sqrt(moments[i + 2] / (1 - 0.999**turn)) + 1e-8)
            if i:
                step = step + change
            else:
                weights = weights + change
    return weights, step


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    picked = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [line_features((t or "").split("\n")[:LINES]).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("good")], names=["x", "good"])

    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "good").mapInArrow(features, "x binary, good int").collect()
    rows = sorted((bytes(r["x"]), r["good"]) for r in rows)
    return train([(np.frombuffer(x).reshape(-1, FEATURES), y) for x, y in rows])


def repeated_words(h: np.ndarray, size: int = RUN) -> int:
    """Words in runs of ``size`` that occur twice or more in the text."""
    runs = rolling(h, size)
    _, back, times = np.unique(runs, return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[back] > 1) if len(runs) else []
    change = np.zeros(len(h) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, np.asarray(at, np.int64) + size, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def line_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, counts, base_failed, kept and content_share.

    Kept are rows that pass the base rules and have at least half of their characters in
    content lines. NULL and empty texts have no words and fail. Rows may repeat; an empty
    table gives none; without usable labels every line is content. Columns other than
    doc_id and text are not read.
    """
    weights, step = fit(docs, labels)
    steps = step.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch):
                out = []
                for text in texts:
                    ws, lines = words(text), text.split("\n")
                    x = line_features(lines)
                    marks = viterbi((x @ weights).tolist(), steps)
                    sizes = [len(line) for line in lines]
                    share = sum(s for s, m in zip(sizes, marks) if m) / (sum(sizes) or 1)
                    repeat = repeated_words(hashed(ws, len(ws)))
                    failed = len(ws) < FEW_WORDS or 100 * repeat > REPEATED_PERCENT * len(ws)
                    out.append(
                        (len(ws), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, SYMBOLS)), int(x[:, 9].sum()), repeat, failed, not failed and share >= SHARE, share)
                    )
                columns = [pa.array(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(texts)), *columns], names=["doc_id", *(c.split()[0] for c in _SCHEMA.split(", "))]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_SCHEMA}")
