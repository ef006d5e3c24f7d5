"""The pipeline's rows against its stages done plainly."""

import corpus_pipeline
import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetspark.llm import minhash
from fleetspark.llm.base import forget, per_worker
from fleetspark.llm.minhash import near_duplicates
from fleetspark.llm.quality import quality_scores

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append(docs)
    return out


def test_stages_but_the_last_return_documents(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(s.columns == columns for s in stages[:-1]) and len(stages) == 5


def test_each_stage_does_its_part(spark, stages):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"] for r in quality_scores(source, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
    rows = [{r["doc_id"]: r for r in s.collect()} for s in stages[:-1]]
    assert set(rows[0]) == good
    first = {}
    for i in sorted(rows[0]):
        first.setdefault(" ".join(rows[0][i]["text"].encode().decode().split()), i)
    assert len(first) >= len(rows[1]) - 3 and set(rows[1]) <= set(rows[0])
    near = {r["class_id"] for r in near_duplicates(stages[1]).collect()}
    assert set(rows[2]) == near
    seen = {}
    split = {i: r["text"].encode().split() for i, r in rows[2].items()}
    for w in split.values():
        for p in range(len(w) - 34):
            key = tuple(w[p : p + 35])
            seen[key] = seen.get(key, 0) + 1
    for i, w in split.items():
        gone = {q for p in range(len(w) - 34) if seen[tuple(w[p : p + 35])] > 1 for q in range(p, p + 35)}
        if not gone:
            assert rows[3][i] == rows[2][i]
        elif len(gone) == len(w):
            assert i not in rows[3]
        else:
            kept = b" ".join(x for j, x in enumerate(w) if j not in gone).decode()
            assert rows[3][i]["text"] == kept and rows[3][i]["n_chars"] == len(kept)


def test_packing_holds_what_is_left(stages):
    kept = {r["doc_id"] for r in stages[3].collect()}
    pieces = stages[4].toPandas()
    assert set(pieces.doc_id) == kept and pieces.groupby("doc_id").length.sum().eq(pieces.groupby("doc_id").doc_tokens.first()).all()


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a  b"), (3, "c")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.without_copies(spark, docs, SF).collect()) == [1, 3]


A, B, C = (" ".join(f"{letter}{i}" for i in range(60)) for letter in "abc")
ODD = [(1, f"{A} {B}"), (1, f"{A} {C}"), (2, "x y"), (2, "y z"), (0, "y  z"), (None, "n"), (None, None), (3, ""), (4, "n"), (4, "n")]
CLASH = ("key", "id", "n", "mark", "again", "sha", "one", "run", "rest", "score", "_id", "_kept", "_again", "_score", "kept_text", "kept_")


def odd(spark, rows=ODD):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in CLASH:
        docs = docs.withColumn(name, F.lit(f"clash {name}"))
    return docs


def left(frame, columns):
    rows = frame.collect()
    assert frame.columns == columns and all(r[c] == f"clash {c}" for r in rows for c in CLASH)
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=str)


def test_repeated_ids_of_different_texts(spark):
    docs = odd(spark)
    exact = left(corpus_pipeline.without_copies(spark, docs, SF), docs.columns)
    assert exact == sorted([(1, f"{A} {B}"), (1, f"{A} {C}"), (2, "x y"), (0, "y  z"), (4, "n"), (3, "")], key=str)
    runs = left(corpus_pipeline.without_repeated_runs(spark, docs, SF), docs.columns)
    assert runs == sorted([(1, B), (1, C), *ODD[2:]], key=str)
    near = left(corpus_pipeline.without_near_copies(spark, odd(spark, [(1, A), (1, A + " b0"), (1, C), (0, C), (5, B), (None, None)]), SF), docs.columns)
    assert len(near) == 4 and {t for _, t in near} - {A, A + " b0"} == {C, B, None}


def test_stages_on_an_empty_table(spark):
    docs = odd(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == [], name


def test_quality_keeps_other_columns(spark):
    docs = odd(spark)
    kept = left(corpus_pipeline.good_documents(spark, docs, SF), docs.columns)
    assert set(kept) <= set(ODD)


def test_stages_send_small_batches_to_python(spark):
    def largest():
        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

        return spark.range(2500).coalesce(1).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(name, "10000")
            stage(spark, odd(spark), SF)
            assert largest() <= corpus_pipeline.BATCH_ROWS, stage
        spark.conf.set(name, "7")
        corpus_pipeline.packed(spark, odd(spark), SF)
        assert largest() == 7
    finally:
        spark.conf.set(name, before)


def test_near_duplicates_need_one_worker_a_task(spark, monkeypatch):
    plans, put = {}, minhash.Scratch.put

    def told(self, frame, name):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        return put(self, frame, name)

    monkeypatch.setattr(minhash.Scratch, "put", told)
    near_duplicates(odd(spark))
    assert plans["texts"].count("MapInArrow") == 1 and max(p.count("MapInArrow") for p in plans.values()) == 1


def test_a_worker_forgets_what_later_steps_do_not_use():
    kept = per_worker(("test",), list)
    assert per_worker(("test",), list) is kept
    forget()
    assert per_worker(("test",), list) is not kept
