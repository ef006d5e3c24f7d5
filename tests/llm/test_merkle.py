"""The manifest against a recomputation on the driver, tampering, and odd tables."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetspark.llm.merkle import merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    doc_id, source, lang, n_chars, text = row
    values = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(names):
    """Root, and for each name its siblings from below, with their side."""
    paths, at, level = [[] for _ in names], list(range(len(names))), names
    while len(level) > 1:
        for i, p in enumerate(at):
            paths[i].append(("L" if p % 2 else "R") + level[p ^ 1] if p ^ 1 < len(level) else "")
        level = [h("".join(level[k : k + 2])) for k in range(0, len(level), 2)]
        at = [p // 2 for p in at]
    return level[0], paths


def recomputed(rows):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append(r)
    langs = sorted(by_lang, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = tree([leaf_of(r) for r in by_lang[lang]])
    root, tops = tree([trees[lang][0] for lang in langs])
    out = []
    for lang, top in zip(langs, tops):
        for r, below in zip(by_lang[lang], trees[lang][1]):
            path = below + top
            at = leaf_of(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for step in path:
                at = h(step[1:] + at if step[:1] == "L" else at + step[1:])
            out.append((r[0], leaf_of(r), trees[lang][0], root, h("".join(s[1:] for s in path)), at, at == root))
    return sorted(out, key=str)


ROWS = [(i, f"s{i % 3}", ["en", "de", None, "", "ünï"][i * i % 5], i, f"text {i} é") for i in range(70)]
ODD = [
    (None, None, None, None, None),
    (None, "a", "en", 3, "x"),
    (7, "", "", 0, ""),
    (7, "", "", 0, ""),
    (7, "", "", 1, ""),
    (2**62, "s", "z", 2**63 - 1, "long " * 60_000),
    (-5, "s", "zz", None, "\n\t "),
]


@pytest.mark.parametrize("bits", [1, 2, 10])
@pytest.mark.parametrize("rows", [ROWS, ODD, ROWS + ODD, ROWS[:1]])
def test_equals_recomputation(spark, bits, rows):
    got = [tuple(r) for r in merkle_manifest(spark.createDataFrame(rows, SCHEMA), bits=bits).collect()]
    assert sorted(got, key=str) == recomputed(rows)


def test_tampered_rows_alone_fail(spark):
    rows = merkle_manifest(spark.createDataFrame(ROWS, SCHEMA)).collect()
    struck = {r[0] for r in ROWS if zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert struck and {r["doc_id"] for r in rows if not r["verified"]} == struck


def test_order_of_input_and_other_columns_do_not_matter(spark):
    docs = spark.createDataFrame(ROWS + ODD, SCHEMA)
    clash = docs.repartition(7, "text").withColumns({c: F.lit("clash") for c in ("grp", "node", "row", "at", "path", "root", "n", "leaf")})
    assert sorted(map(str, merkle_manifest(clash).collect())) == sorted(map(str, merkle_manifest(docs).collect()))


def test_path_leads_to_the_root(spark):
    for r in merkle_manifest(spark.createDataFrame(ROWS, SCHEMA), with_path=True, bits=2).collect():
        at = r["leaf"]
        for step in r["path"]:
            at = h(step[1:] + at if step[:1] == "L" else at + step[1:])
        assert at == r["root"]


def test_empty_table(spark):
    assert merkle_manifest(spark.createDataFrame([], SCHEMA)).collect() == []
