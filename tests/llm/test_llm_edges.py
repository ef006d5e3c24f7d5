"""NULLs, empty texts, ties, repeated rows, empty tables and clashing columns, for all operators."""

import pytest
from pyspark.sql import functions as F

from fleetspark.llm.base import shared_folder
from fleetspark.llm.brown import class_scores
from fleetspark.llm.chat import formatted_chats
from fleetspark.llm.exact import exact_duplicates
from fleetspark.llm.langid import page_languages
from fleetspark.llm.lines import line_rules
from fleetspark.llm.minhash import near_duplicates
from fleetspark.llm.packing import pack
from fleetspark.llm.quality import quality_scores, scored
from fleetspark.llm.queries import tokenizer_file
from fleetspark.llm.spiece import encoded
from fleetspark.llm.substring import repeated_runs

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(40_000))
ROWS = [(1, "a b c"), (2, None), (3, ""), (4, "  \n\t "), (5, "a  b\nc"), (5, "a  b\nc"), (6, LONG), (7, "x" * 50_000), (None, "no id here"), (8, "ünï cödé   \x1c <|endoftext|> 'S")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("anchor", "score", "size", "class", "n", "node", "row", "block", "held_out", "good"):
        frame = frame.withColumn(name, F.lit(f"clash {name}"))
    return frame


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 1), (3, 0), (4, None), (None, 1), (6, 1), (7, 0)], "doc_id long, quality int")


def operators(labels):
    word, piece = tokenizer_file("word_bpe_49k.json"), tokenizer_file("piece_bpe_32k.model")
    return {
        "substring": repeated_runs,
        "near": near_duplicates,
        "quality": lambda d: quality_scores(d, labels),
        "exact": exact_duplicates,
        "brown": class_scores,
        "lines": lambda d: line_rules(d, labels),
        "pieces": lambda d: encoded(d, piece),
        "packing": lambda d: pack(d, word),
    }


NAMES = ["substring", "near", "quality", "exact", "brown", "lines", "pieces", "packing"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_is_answered(docs, labels, name):
    rows = operators(labels)[name](docs).collect()
    ids = [r["doc_id"] for r in rows]
    if name == "packing":
        assert set(ids) == {r[0] for r in ROWS}
    else:
        assert sorted(ids, key=str) == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_an_empty_table_gives_no_rows(docs, labels, name):
    assert operators(labels)[name](docs.limit(0)).collect() == []


def test_exact_edges(docs):
    rows = exact_duplicates(docs).collect()
    own = {r["doc_id"]: r for r in rows if r["doc_id"] not in (5,)}
    assert own[3]["keep_id"] == 2 and own[3]["group_size"] == 2  # NULL is empty; blanks are one space
    assert own[4]["keep_id"] == 4 and own[None]["kept"]
    assert own[1]["group_size"] == 3 and own[1]["kept"]
    five = [r for r in rows if r["doc_id"] == 5]
    assert [r["keep_id"] for r in five] == [1, 1] and not any(r["kept"] for r in five)


def test_one_of_repeated_rows_is_kept(spark):
    rows = exact_duplicates(spark.createDataFrame([(1, "t")] * 2500, SCHEMA)).collect()
    assert len(rows) == 2500 and sum(r["kept"] for r in rows) == 1 and {r["group_size"] for r in rows} == {2500}


def test_near_edges(docs):
    rows = near_duplicates(docs).collect()
    classes = {r["doc_id"]: r["class_id"] for r in rows}
    assert classes[1] == classes[5] == 1 and classes[2] == classes[3] == classes[4] == 2 and classes[6] == 6


def test_labels_without_use(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_scores(docs, none).collect()} == {0.5}
    assert all(r["content_share"] in (0.0, 1.0) for r in line_rules(docs, none).collect())


def test_scores_refuse_a_clash(docs):
    with pytest.raises(ValueError):
        scored(docs, None)


def test_a_shared_folder_is_needed_on_a_cluster(spark):
    class Context:
        master, applicationId = "yarn", "x"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError):
        shared_folder(Session())


def test_chat_and_pages_edges(spark):
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "robot", ""), (2, 5, "assistant", "x" * 30_000)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("block", F.lit("clash"))
    rows = formatted_chats(frame).collect()
    assert len(rows) == 4
    assert formatted_chats(frame.limit(0)).collect() == []
    pages = [(1, None, None), (2, "", ""), (3, "http://a.b.de/x", "<html lang='de'><p>und der die das ist</p>"), (3, "http://a.b.de/x", "<html lang='de'><p>und der die das ist</p>"), (None, "::", "x" * 50_000)]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    docs = spark.createDataFrame([(1, "de", "und der die das ist nicht ein und der"), (2, "en", "the and of to in is that the and"), (3, None, "?")], "doc_id long, lang string, text string")
    rows = page_languages(pages, docs).collect()
    assert len(rows) == 5 and [r["lang"] for r in rows if r["page_id"] == 3] == ["de", "de"]
    assert page_languages(pages.limit(0), docs).collect() == []
    assert {r["lang"] for r in page_languages(pages, docs.limit(0)).collect()} == {None}


def test_runs_shared_with_a_row_without_id(spark):
    shared = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "a " + shared), (None, shared + " b"), (None, "c " + shared), (None, None), (None, "short")]
    got = repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in got) == [(0, 0, 0), (0, 1, 0), (0, 61, 60), (0, 61, 60), (1, 61, 60)]
