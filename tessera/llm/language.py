"""Multilingual mixture inference: language proportions by expectation maximisation.

A language is a distribution over hashed byte trigrams of lower-cased letters. A document is
a mixture of languages: EM estimates the proportions from its trigrams' likelihoods, and the
set of languages is the one of highest likelihood less a penalty for each language more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import pick, text_slices

#: Trigrams are hashed to this many cells.
CELLS = 1 << 16
#: A model has so many languages at most: its matrix is CELLS x languages of 4 bytes.
MOST_LANGUAGES = 512
UNDETERMINED = "und"


@dataclass(frozen=True)
class MixtureRules:
    """Smoothing, EM rounds, least share of a language in a set, and the weight of the penalty.

    Neighbouring trigrams overlap, so a document of n trigrams counts as n / ``overlap`` of them.
    """

    smoothing: float = 0.5
    rounds: int = 12
    least_share: float = 0.03
    overlap: float = 3.0
    penalty: float = 1.0


def is_training_row(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves another remainder than 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(True))


def trigram_cells() -> Callable:
    """A function from texts to, per text, its trigrams' cells as one array."""
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        if not (97 <= b <= 122):
            table[b] = 32

    def run(texts: list[str]) -> list[np.ndarray]:
        raws = [b"  " + (t or "").lower().encode() + b"  " for t in texts]
        joined = table[np.frombuffer(b"".join(raws), np.uint8)].astype(np.uint32)
        code = joined[:-2] << 16 | joined[1:-1] << 8 | joined[2:]
        blank = (joined[:-2] == 32) & (joined[1:-1] == 32)
        cell = (code * np.uint32(2654435761)) >> np.uint32(16)
        ends = np.cumsum([len(r) for r in raws])
        return [cell[e - len(r) : e - 2][~blank[e - len(r) : e - 2]] for r, e in zip(raws, ends, strict=True)]

    return run


def cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to (lang, cell, n): one row per language and cell that the partition holds."""
    cells, counts = trigram_cells(), {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for start, end in text_slices(texts):
            for lang, found in zip(langs[start:end], cells(texts[start:end]), strict=True):
                if lang not in counts:
                    counts[lang] = np.zeros(CELLS, np.int64)
                counts[lang] += np.bincount(found, minlength=CELLS)
    for lang, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "cell", "n"])


def train(docs: DataFrame, rules: MixtureRules = MixtureRules()) -> tuple[list[str], np.ndarray]:
    """(languages, log-free likelihoods CELLS x languages) from all rows of (text, lang) with a language.

    All labelled rows count. What reaches the driver is one row of CELLS numbers a language, one after the
    other, of MOST_LANGUAGES at most; more languages are refused.
    """
    rows = pick(docs, lang="string", text="string").filter("lang is not null and text is not null")
    table = rows.mapInArrow(cell_counts, "lang string, cell bigint, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    place = {lang: i for i, lang in enumerate(langs)}
    model = np.empty((CELLS, len(langs)), np.float32)
    model[:] = 1 / CELLS  # of a language without a trigram
    for r in table.groupBy("lang").applyInArrow(dense_counts, "lang string, counts binary").toLocalIterator():
        counts = np.frombuffer(r["counts"], np.int64) + rules.smoothing
        model[:, place[r["lang"]]] = counts / counts.sum()
    return langs, model


def dense_counts(table: pa.Table) -> pa.Table:
    """A language's rows (lang, cell, n), CELLS of them at most, as one of all cells."""
    counts = np.zeros(CELLS, np.int64)
    counts[table["cell"].to_numpy()] = table["n"].to_numpy()
    return pa.table({"lang": table["lang"][:1], "counts": pa.array([counts.tobytes()], pa.binary())})


def proportions(like: np.ndarray, weight: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """EM over rows of likelihoods: the languages' proportions and the log-likelihood under them."""
    k = like.shape[1]
    share = np.full(k, 1 / k)
    total = weight.sum()
    for _ in range(rounds if k > 1 else 0):
        share = share * ((weight / (like @ share)) @ like) / total
    return share, float(weight @ np.log(like @ share))


def infer(cells: np.ndarray, model: np.ndarray, rules: MixtureRules) -> dict[int, float]:
    """The chosen set of languages and their proportions, largest first."""
    if not len(cells) or not model.shape[1]:
        return {}
    at, n = np.unique(cells, return_counts=True)
    like, weight = model[at].astype(np.float64), n / rules.overlap
    share, _ = proportions(like, weight, rules.rounds)
    order = np.argsort(-share, kind="stable")
    most = max(1, int((share[order] >= rules.least_share).sum()))
    best, chosen = -np.inf, {}
    for k in range(1, most + 1):
        some = order[:k]
        part, fit = proportions(like[:, some], weight, rules.rounds)
        value = fit - rules.penalty * 0.5 * (k - 1) * np.log(weight.sum() + 1)
        if value > best:
            best, chosen = value, dict(zip(some.tolist(), part.tolist(), strict=True))
    return dict(sorted(chosen.items(), key=lambda x: (-x[1], x[0])))


def predictor(langs: list[str], model, rules: MixtureRules, text_at: int) -> Callable:
    """Batches with the text in column ``text_at`` gain (lang_pred, score, mixture)."""
    kinds = [pa.string(), pa.float64(), pa.map_(pa.string(), pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, matrix = trigram_cells(), model.value
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            best, score, mixture = [], [], []
            for start, end in text_slices(texts):
                for text, found in zip(texts[start:end], cells(texts[start:end]), strict=True):
                    known = text is not None and any(map(str.isalpha, text))
                    shares = infer(found, matrix, rules) if known else {}
                    top = next(iter(shares), None)
                    best.append(UNDETERMINED if top is None else langs[top])
                    score.append(0.0 if top is None else min(1.0, max(0.0, shares[top])))
                    mixture.append([(langs[i], s) for i, s in shares.items()])
            made = [pa.array(x, k) for x, k in zip((best, score, mixture), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "lang_pred", "score", "mixture"])

    return run


def with_language(docs: DataFrame, training: DataFrame, rules: MixtureRules = MixtureRules()) -> DataFrame:
    """``docs`` (columns c0, c1, ... and their order kept) with lang_pred, score and mixture.

    The model learns from ``training``; a prediction sees the text alone. A null text or one
    without a letter gives ``und``, score 0 and an empty mixture, as does an empty training
    table. ``score`` is the proportion of the predicted language.
    """
    langs, matrix = train(training, rules)
    model = docs.sparkSession.sparkContext.broadcast(matrix)
    text_at = docs.columns.index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    plain = plain.withColumn(f"c{text_at}", F.col(f"c{text_at}").cast("string"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    schema = f"{fields}, lang_pred string, score double, mixture map<string,double>"
    return plain.mapInArrow(predictor(langs, model, rules, text_at), schema)


def training_rows(docs: DataFrame) -> DataFrame:
    rows = pick(docs, doc_id="bigint", text="string", lang="string")
    return rows.filter(is_training_row(F.col("doc_id")))


def predict_languages(docs: DataFrame, rules: MixtureRules = MixtureRules()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, mixture) for every row; held-out rows teach nothing."""
    rows = pick(docs, doc_id="bigint", text="string")
    found = with_language(rows, training_rows(docs), rules)
    return found.select(
        F.col("c0").alias("doc_id"), (~is_training_row(F.col("c0"))).alias("held_out"), "lang_pred", "score", "mixture"
    )


def keep_known(docs: DataFrame, least_score: float = 0.5, rules: MixtureRules = MixtureRules()) -> DataFrame:
    """``docs`` without rows of no language or of none that makes up ``least_score`` of the text."""
    found = with_language(docs, training_rows(docs), rules)
    kept = found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score))
    return kept.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)
