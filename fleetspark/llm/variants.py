"""Spelling variants: words one edit apart, each pointed at its most frequent neighbour.

The vocabulary's acceptor A is composed with a one-edit transducer and with A again. Up
to the edit both sides read the same string, so they are in the same state of A; after
it both must read the same rest. Pairs are parted by the state they start from, that is
by a prefix: a state with at most PART words goes to one task, which builds the minimal
acceptor of the words behind it, composes, and enumerates the accepted pairs. A larger
state is left over its arcs. Equal arcs lead to the states of longer prefixes. Arcs that
edit must be followed by equal rests, which an equality on (prefix, rest) finds; there
at most one word per letter meets, whatever the vocabulary's size. So no task holds more
than PART words, and no pair is lost or found twice.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.base import Scratch, chunks

DROP, LEAST_LETTERS, LEAST_TIMES, TIMES_MORE = 97, 5, 3, 2
PART = 4096
HELD_WORDS = 200_000
SLICE_CHARS = 1_000_000
_RUN = re.compile("[a-zÀ-ÿ]+")


def _runs(text: str) -> Iterator[list[str]]:
    """Lower-cased runs of letters, some at a time; a run is never cut."""
    text = text.encode().lower().decode()
    if len(text) <= SLICE_CHARS:
        yield _RUN.findall(text)
        return
    start = 0
    while start < len(text):
        end = start + SLICE_CHARS
        split = _RUN.match(text, end)
        end = split.end() if split else end
        yield _RUN.findall(text, start, end)
        start = end


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES, drop: int = DROP) -> DataFrame:
    """(word, n): words of all texts, one letter lost where ``drop`` divides the run's checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            ids = batch.column("id").to_pylist()
            for first, texts in chunks(batch):
                for i, text in enumerate(texts, first):
                    seed = zlib.crc32(f"{'' if ids[i] is None else ids[i]}:".encode())
                    for runs in _runs(text):
                        for word, n in Counter(runs).items():
                            h = zlib.crc32(word.encode(), seed)
                            if h % drop == 0:
                                gone = h % len(word)
                                word = word[:gone] + word[gone + 1 :]
                            if len(word) >= least_letters:
                                held[word] += n
                    if len(held) > HELD_WORDS:
                        yield rows()
                        held.clear()
        yield rows()

    counts = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_times)


class Acceptor:
    """Minimal acyclic acceptor of sorted distinct words.

    State s accepts the empty rest if ``final[s]``; ``arcs[s]`` maps a letter to the next
    state and to the number of words of s that come before those behind the arc, so a
    path adds up to its word's place in order.
    """

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[bool, dict[str, int]]] = [(False, {})]
        last = ""

        def close(depth: int) -> None:
            """Give states deeper than ``depth`` on the last word's path their numbers."""
            while len(path) > depth + 1:
                final, to = path.pop()
                path[-1][1][last[len(path) - 1]] = self._state(known, final, to)

        for word in words:
            same = 0
            while same < min(len(last), len(word)) and last[same] == word[same]:
                same += 1
            close(same)
            path.extend((False, {}) for _ in word[same:])
            path[-1] = (True, path[-1][1])
            last = word
        close(0)
        self.start = self._state(known, *path[0])

    def _state(self, known: dict[tuple, int], final: bool, to: dict[str, int]) -> int:
        key = (final, *to.items())
        state = known.get(key)
        if state is None:
            known[key] = state = len(self.final)
            arcs, before = {}, int(final)
            for letter, target in to.items():
                arcs[letter] = (target, before)
                before += self.size[target]
            self.final.append(final)
            self.arcs.append(arcs)
            self.size.append(before)
        return state


def accepted_pairs(words: list[str]) -> list[tuple[int, int]]:
    """Places of any two words that one edit parts; words are sorted and distinct, each pair comes once."""
    a = Acceptor(words)
    final, arcs = a.final, a.arcs
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * max(map(len, words), default=0) + 10_000))
    shared: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def equal_rests(p: int, q: int) -> list[tuple[int, int]]:
        """Places in p and q of the words that both accept: the composition after its edit."""
        if p == q:
            return [(i, i) for i in range(a.size[p])]
        if p > q:
            return [(j, i) for i, j in equal_rests(q, p)]
        found = shared.get((p, q))
        if found is None:
            found = [(0, 0)] if final[p] and final[q] else []
            there = arcs[q]
            for letter, (to, before) in arcs[p].items():
                if letter in there:
                    other, ahead = there[letter]
                    found += [(i + before, j + ahead) for i, j in equal_rests(to, other)]
            shared[p, q] = found
        return found

    pairs = []
    waiting = [(a.start, 0)]
    while waiting:
        p, base = waiting.pop()
        out = list(arcs[p].items())
        for k, (letter, (to, before)) in enumerate(out):
            waiting.append((to, base + before))
            here = base + before
            for _, (other, ahead) in out[k + 1 :]:  # one letter for another
                pairs += [(here + i, base + ahead + j) for i, j in equal_rests(to, other)]
            if final[to] and final[p]:  # the letter is left out at the end
                pairs.append((here, base))
            for follows, (rest, skipped) in arcs[to].items():  # left out before another letter
                if follows != letter and follows in arcs[p]:
                    other, ahead = arcs[p][follows]
                    pairs += [(here + skipped + i, base + ahead + j) for i, j in equal_rests(rest, other)]
    return pairs


_FOUND = "word string, n_near long, best struct<less: long, word: string>"


def _in_parts(words: DataFrame) -> DataFrame:
    """(prefix, word, n) to the neighbours of each word that share at least the prefix."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("word").to_pylist(), table.column("n").to_pylist()))
        words, n = [w for w, _ in rows], np.array([c for _, c in rows], np.int64)
        pairs = np.array(accepted_pairs(words), np.int64).reshape(-1, 2)
        near = np.bincount(pairs.ravel(), minlength=len(words))
        order = np.lexsort((np.arange(len(words)), -n))
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        best = np.full(len(words), len(words))
        for here, there in ((0, 1), (1, 0)):
            np.minimum.at(best, pairs[:, here], rank[pairs[:, there]])
        with_any = np.flatnonzero(near)
        chosen = order[best[with_any]].tolist()
        return pa.table(
            {
                "word": pa.array([words[i] for i in with_any.tolist()], pa.string()),
                "n_near": pa.array(near[with_any].astype(np.int64)),
                "best": pa.StructArray.from_arrays([pa.array([-int(n[i]) for i in chosen], pa.int64()), pa.array([words[i] for i in chosen], pa.string())], names=["less", "word"]),
            }
        )

    return words.groupBy("prefix").applyInArrow(run, _FOUND)


def _at_edit(words: DataFrame, depth: int) -> DataFrame:
    """Neighbours whose edit is at letter ``depth``: equal prefixes before it, equal rests after it.

    All words of one (prefix, rest) differ in one letter, so they are no more than letters.
    """
    me = F.struct((-F.col("n")).alias("less"), "word")
    letter, follows = F.substring("word", depth + 1, 1), F.substring("word", depth + 2, 1)
    short = F.concat(F.substring("word", 1, depth), F.substring("word", depth + 2, 1 << 30))
    rows = words.filter(F.length("word") > depth).select(short.alias("rest"), me.alias("me"), (letter != follows).alias("first"), F.lit(False).alias("whole"))
    rows = rows.unionByName(words.select(F.col("word").alias("rest"), me.alias("me"), F.lit(False).alias("first"), F.lit(True).alias("whole")))
    met = rows.groupBy("rest").agg(
        F.sort_array(F.collect_list(F.when(~F.col("whole"), F.struct("me", "first")))).alias("edited"),
        F.max(F.when(F.col("whole"), F.col("me"))).alias("whole"),
    )
    met = met.filter(F.size("edited") + F.col("whole").isNotNull().cast("int") > 1)
    shorter = met.filter(F.col("whole").isNotNull()).select("whole", F.filter("edited", lambda e: e["first"]).alias("longer")).filter(F.size("longer") > 0)
    shorter = shorter.select(F.col("whole.word").alias("word"), F.size("longer").cast("long").alias("n_near"), F.col("longer")[0]["me"].alias("best"))
    each = met.select(F.posexplode("edited").alias("i", "e"), (F.size("edited") - 1).alias("others"), "edited", "whole")
    other = F.get("edited", F.when(F.col("i") == 0, 1).otherwise(0))["me"]
    whole = F.when(F.col("e.first"), F.col("whole"))
    each = each.select(
        F.col("e.me.word").alias("word"), (F.col("others") + whole.isNotNull().cast("int")).cast("long").alias("n_near"), F.least(other, whole).alias("best")
    )
    return shorter.unionByName(each.filter("n_near > 0"))


def neighbours(words: DataFrame, scratch: Scratch, part: int = PART) -> DataFrame:
    """(word, n) to (word, n_near, best): the number of words one edit away and the most frequent of them."""
    found, depth, left = None, 0, words
    while True:
        prefix = F.substring("word", 1, depth)
        sizes = left.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("size"))
        sizes = scratch.put(sizes, f"sizes{depth}")
        keyed = left.withColumn("prefix", prefix).join(sizes, "prefix")
        some = _in_parts(keyed.filter(F.col("size").between(2, part)).select("prefix", "word", "n"))
        more = not sizes.filter(F.col("size") > part).isEmpty()
        if more:
            left = scratch.put(keyed.filter(F.col("size") > part).select("word", "n"), f"left{depth}")
            some = some.unionByName(_at_edit(left, depth)) if depth else _at_edit(left, depth)
            left = left.filter(F.length("word") > depth)
        some = scratch.put(some, f"found{depth}")
        found = some if found is None else found.unionByName(some)
        if not more:
            return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
        depth += 1


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, form) to (word, root), the end of each chain of forms; every step doubles the reach."""
    at, step = scratch.put(forms.select("word", F.col("form").alias("root")), "roots"), 0
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(ahead, "root", "left")
        if moved.filter(F.col("next").isNotNull()).isEmpty():
            return at
        at, step = scratch.put(moved.select("word", F.coalesce("next", "root").alias("root")), f"roots{step}"), step + 1


def spelling_variants(docs: DataFrame, part: int = PART, least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES, drop: int = DROP) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A word's form is its most frequent neighbour (ties: the first in code-point order) if
    that is at least TIMES_MORE as frequent, else NULL; counts double along a chain of
    forms, so chains end, and the root is their last word. NULL and empty texts have no
    words; a NULL doc_id counts as the empty string in the checksum that drops letters;
    repeated rows count each time; an empty table gives no row. Columns other than doc_id
    and text are not read. Texts and words may be of any length.
    """
    scratch = Scratch(docs.sparkSession, "variants")
    words = scratch.put(word_counts(docs, least_letters, least_times, drop), "words")
    near = neighbours(words, scratch, part)
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= TIMES_MORE * F.col("n"), F.col("best")).alias("form")
    )
    rows = scratch.put(rows, "rows")
    ends = roots(rows.filter("form is not null").select("word", "form.word").toDF("word", "form"), scratch)
    return rows.join(ends, "word", "left").select(
        "word", F.col("form.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("form.less")).alias("form_n")
    )
