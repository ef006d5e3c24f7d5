"""Five stages from raw documents to packed sequences; each applies one operator.

A stage reads its predecessor's whole output, which was written as Parquet. All but the
last return the columns of documents. Calling a stage sets the session's
spark.sql.execution.arrow.maxRecordsPerBatch to BATCH_ROWS at most.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspark.llm.base import read, shared_folder
from fleetspark.llm.exact import exact_duplicates, normalised
from fleetspark.llm.minhash import near_duplicates
from fleetspark.llm.packing import pack
from fleetspark.llm.quality import KEEP_AT, fit, scored
from fleetspark.llm.queries import tokenizer_file
from fleetspark.llm.substring import repeated_runs


#: Rows that travel to or from a Python worker at a time. They hold whole texts; executors
#: keep the native memory of the largest batches from stage to stage.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose result, which the caller computes, goes through Python in batches of BATCH_ROWS at most."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
            spark.conf.set(_ROWS, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


@in_small_batches
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    NULL and empty texts are scored like others; repeated rows get equal scores.
    """
    network = fit(docs, read(spark, sf_dir, "labels"))
    score = _free(docs, "score")
    return scored(docs, network, score).filter(F.col(score) >= KEEP_AT).drop(score)


def _with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """Documents with a key for each pair of id and text: the id itself where it is the only row's.

    Rows of a repeated or NULL id get a negative number made of id and text, so that the
    operators, which answer by id, tell them apart.
    """
    key, id_, n = _free(docs, "key"), _free(docs, "id"), _free(docs, "n")
    again = docs.groupBy(F.col("doc_id").alias(id_)).agg(F.count("*").alias(n)).filter((F.col(n) > 1) | F.col(id_).isNull())
    made = -F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(1 << 62)) - 1
    rows = docs.join(again, F.col("doc_id").eqNullSafe(F.col(id_)), "left")
    return rows.withColumn(key, F.when(F.col(n).isNull(), F.col("doc_id")).otherwise(made)).select(*docs.columns, key), key


def _kept_rows(docs: DataFrame, keyed: DataFrame, key: str, marks: DataFrame) -> DataFrame:
    """Rows whose key is kept; of rows with equal keys, which have equal ids and texts, one.

    ``marks`` has (doc_id, kept), where doc_id is the key.
    """
    name, again = _free(keyed, "mark"), _free(keyed, "again")
    kept = marks.groupBy(F.col("doc_id").alias(name)).agg(F.max("kept").alias("kept_"), (F.count("*") > 1).alias(again))
    rows = keyed.join(kept.filter("kept_").drop("kept_"), F.col(key) == F.col(name))
    one = rows.filter(F.col(again)).dropDuplicates([key])
    return rows.filter(~F.col(again)).unionByName(one).select(*docs.columns)


@in_small_batches
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id; a NULL text counts as empty, NULL ids come last."""
    source = docs.select(F.col("doc_id"), "text")
    marks = exact_duplicates(source).filter("kept")
    id_, sha, one = _free(docs, "id"), _free(docs, "sha"), _free(docs, "one")
    marks = marks.select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha), (F.col("group_size") == 1).alias(one)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.sha2(normalised(F.col("text")), 256) == F.col(sha))
    rows = docs.join(marks, same)
    # Rows of a group may repeat the smallest id too; one of them stays.
    some = rows.filter(~F.col(one)).dropDuplicates([id_, sha])
    return rows.filter(F.col(one)).unionByName(some).select(*docs.columns)


@in_small_batches
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates; NULL and empty texts are one class."""
    keyed, key = _with_key(docs)
    return _kept_rows(docs, keyed, key, near_duplicates(keyed, id_col=key))


@in_small_batches
def without_repeated_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of 35 or more words that also stand elsewhere.

    A text that loses nothing stays as it is, NULL too; one that loses every word leaves.
    Each row gets its own text's rest, also where ids repeat.
    """
    keyed, key = _with_key(docs)
    runs = repeated_runs(keyed, id_col=key, with_text=True).filter("n_removed < n_words or n_removed = 0")
    name, rest = _free(keyed, "run"), _free(keyed, "rest")
    runs = runs.select(F.col("doc_id").alias(name), F.col("kept_text").alias(rest)).dropDuplicates([name])
    joined = keyed.join(runs, F.col(key) == F.col(name))
    changed = joined.withColumn("text", F.coalesce(rest, "text"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(rest).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


@in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; a NULL or empty text is its end id alone."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality", good_documents),
    ("exact", without_copies),
    ("near", without_near_copies),
    ("substring", without_repeated_runs),
    ("packing", packed),
]

#: The classifier and the sampling of near duplicates have no SQL form; a brute-force test stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, writing each result to the shared folder."""
    import uuid

    docs = read(spark, sf_dir, "documents")
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
