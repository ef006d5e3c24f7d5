"""Spelling variants against plain recomputation."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetspark.llm.variants import Acceptor, accepted_pairs, spelling_variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(rng, n, letters="abc", longest=7):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)})


@pytest.mark.parametrize("seed", range(6))
def test_pairs_by_brute_force(seed):
    rng = random.Random(seed)
    words = words_of(rng, 250, "ab" if seed % 2 else "abcdé")
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}
    got = [tuple(sorted((words[i], words[j]))) for i, j in accepted_pairs(words)]
    assert len(got) == len(set(got)) and set(got) == want


def test_acceptor_is_minimal_and_numbers_its_words():
    words = words_of(random.Random(9), 300)
    a = Acceptor(words)
    for place, word in enumerate(words):
        state, at = a.start, 0
        for letter in word:
            state, before = a.arcs[state][letter]
            at += before
        assert a.final[state] and at == place
    rests = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:k] for k in range(len(w) + 1))}
    assert len(a.final) == len(rests)


def test_long_words():
    a, b = "x" * 30_000, "y" + "x" * 29_999
    assert sorted(map(sorted, accepted_pairs(sorted([a, b, "x" * 29_999])))) == [[0, 1], [0, 2], [1, 2]]


def recomputed(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            hash_ = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if hash_ % 97 == 0:
                run = run[: hash_ % len(run)] + run[hash_ % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 3}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = ["banana", "Bandana", "ÉTUDEs", "étudeß", "straße", "quickly", "letters", "aaaaaa", "aaaaa", "aaaaaaa"]
    made = []
    for i in range(300):
        words = []
        for _ in range(30):
            w = base[min(int(rng.expovariate(0.5)), len(base) - 1)]
            if rng.random() < 0.5:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "a", "n", "×", w[k] * 2]) + w[k + 1 :]
            words.append(w)
        made.append((i % 290, rng.choice([" ", ", ", "\n", "9"]).join(words)))
    return made + [(None, "banana banana bandana"), (400, None), (401, ""), (402, " \n"), (403, "bananas " * 50_000), (404, "b" * 30_000)]


@pytest.mark.parametrize("part", [4, 4096])
def test_equals_recomputation(spark, rows, part):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "prefix", "id", "rest", "size")})
    got = sorted((tuple(r) for r in spelling_variants(docs, part=part).collect()), key=str)
    assert got == recomputed(rows) and any(r[1] for r in got) and any(r[2] != r[1] and r[1] for r in got)


def test_empty_table(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
