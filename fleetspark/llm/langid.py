"""Language of web pages by Bayesian fusion of four kinds of evidence.

Text: likelihood ratios of character trigrams, tempered by length since neighbouring
trigrams are not independent. Markup: the declared language, by how often pages of each
(text-only) language declare it. Address: how often they carry its suffix. Host: shares
of languages among the host's pages, smoothed towards its domain's, towards its suffix's,
towards all pages' shares. All tables but the trigrams' come from grouped sums over every
page; a page's own share is taken out of its host's, domain's and suffix's sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.llm.base import Scratch

BINS = 1 << 14
SAMPLE = 4000
TEMPER = 200
PULL = 4.0

_HIDDEN = re.compile(r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"(?s)<[^>]*>")
_ENTITY = re.compile(r"&#?\w+;")
_OTHER = re.compile(r"[\W\d_]+")
_LANG = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b")
_HOST = re.compile(r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")


def visible(html: str | None) -> str:
    """Letters that a reader sees, in lower case, words parted by one space."""
    text = _TAG.sub(" ", _HIDDEN.sub(" ", html or ""))
    return _OTHER.sub(" ", _ENTITY.sub(" ", text).lower()).strip()


def trigrams(text: str) -> np.ndarray:
    """Bins of all runs of three characters, a space at either end."""
    c = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(c) < 3:
        return np.empty(0, np.int64)
    x = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA77) + c[2:]
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)).astype(np.int64)


def address(url: str | None) -> tuple[str, str, str]:
    """Host, domain (its last two labels) and suffix (its last), '' where there is none."""
    found = _HOST.match((url or "").strip())
    labels = [x for x in found[1].lower().rstrip(".").split(".") if x] if found else []
    return ".".join(labels), ".".join(labels[-2:]), labels[-1] if labels else ""


def fit_text(documents: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and log-likelihoods of bins, from at most ``sample`` documents chosen by hash."""
    known = documents.filter(F.col("lang").isNotNull())
    picked = known.select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(sample).distinct()
    picked = known.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                n = np.bincount(trigrams(_OTHER.sub(" ", (text or "").lower()).strip()), minlength=BINS)
                sums[lang] = sums.get(lang, 0) + n
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.astype(np.int64).tobytes() for v in sums.values()])], names=["lang", "n"])

    total: dict[str, np.ndarray] = {}
    for row in picked.repartition(8, "doc_id").select("lang", "text").mapInArrow(count, "lang string, n binary").toLocalIterator():
        total[row["lang"]] = total.get(row["lang"], 0) + np.frombuffer(row["n"], np.int64)
    langs = sorted(total)
    table = np.array([total[k] for k in langs], float).reshape(len(langs), BINS) + 0.1
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def page_languages(pages: DataFrame, documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per page: page_id, lang, probability, text_lang, declared, host.

    NULL or empty markup leaves the text likelihood flat, a NULL url the host, domain and
    suffix ''. A page without any evidence gets the most common language; ties go to the
    first in alphabetical order. Without labelled documents lang is NULL and probability
    0. Repeated rows are answered as often as they occur. An empty table gives no rows.
    Columns other than page_id, url and html are not read.
    """
    scratch = Scratch(pages.sparkSession, "langid")
    langs, table = fit_text(documents, sample)
    width = len(langs)
    if not width:
        none = F.lit(None).cast("string")
        return pages.select("page_id", none.alias("lang"), F.lit(0.0).alias("probability"), none.alias("text_lang"), none.alias("declared"), none.alias("host"))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likely, declared, places = [], [], []
            for url, html in zip(batch.column("url"), batch.column("html")):
                html = html.as_py() or ""
                bins = np.bincount(trigrams(visible(html)), minlength=BINS)
                n = bins.sum()
                score = table @ bins * (min(n, TEMPER) / n if n else 0)
                likely.append(score - score.max())
                found = _LANG.search(html)
                declared.append(found[1].lower()[:2] if found else "")
                places.append(address(url.as_py()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array(likely, pa.list_(pa.float64())), pa.array(declared, pa.string()), *(pa.array(c, pa.string()) for c in zip(*places))],
                names=["page_id", "likely", "declared", "host", "domain", "suffix"],
            ) if likely else batch.slice(0, 0)

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = scratch.put(
        pages.select("page_id", "url", "html").mapInArrow(
            evidence, f"page_id {kind}, likely array<double>, declared string, host string, domain string, suffix string"
        ),
        "rows",
    )
    weights = [F.exp(F.col("likely")[i]) for i in range(width)]
    whole = sum(weights[1:], weights[0])
    soft = rows.select("*", *[(w / whole).alias(f"p{i}") for i, w in enumerate(weights)])
    names = [f"p{i}" for i in range(width)]
    sums = lambda prefix: [F.sum(n).alias(f"{prefix}{i}") for i, n in enumerate(names)]
    total = np.array([x or 0.0 for x in soft.agg(*sums("t")).first()])
    share = (total + 1) / (total.sum() + width)
    joined = soft
    for level in ("suffix", "domain", "host"):
        joined = joined.join(soft.groupBy(level).agg(*sums(f"{level}_")), level)
    joined = joined.join(soft.groupBy("declared").agg(*sums("declared_"), F.count("*").alias("declared_n")), "declared")
    kinds = rows.select("declared").distinct().count() + 1
    levels = ("suffix_", "domain_", "host_", "declared_")
    columns = [f"{level}{i}" for level in levels for i in range(width)]

    def fused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            likely = np.array(batch.column("likely").to_pylist())
            own = _softmax(likely)
            side = np.stack([batch.column(c).to_numpy() for c in columns], 1).reshape(-1, len(levels), width)
            prior = np.broadcast_to(share, own.shape)
            for k in range(3):
                others = np.maximum(side[:, k] - own, 0)
                prior = (others + PULL * prior) / (others.sum(1, keepdims=True) + PULL)
            said = (np.maximum(side[:, 3] - own, 0) + 0.5) / (total - own + 0.5 * kinds)
            said = np.where(np.array(batch.column("declared").to_pylist())[:, None] == "", 1.0, said)
            posterior = _softmax(likely + np.log(prior) + np.log(said))
            best = posterior.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    pa.array([langs[i] for i in best]),
                    pa.array(posterior[np.arange(len(best)), best]),
                    pa.array([langs[i] for i in likely.argmax(1)]),
                    batch.column("declared"),
                    batch.column("host"),
                ],
                names=["page_id", "lang", "probability", "text_lang", "declared", "host"],
            )

    return joined.select("page_id", "likely", "declared", "host", *columns).mapInArrow(
        fused, f"page_id {kind}, lang string, probability double, text_lang string, declared string, host string"
    )
