"""Language of a text by multilingual mixture inference.

A text's letter trigrams are taken as draws from a mixture of languages. Expectation-maximisation
estimates the proportions from each language's trigram probabilities; the set of languages is the one
with the best likelihood after a penalty for each language (Lui, Lau and Baldwin, 2014, use such sets).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, remainder
from .textkit import mix

BUCKETS = 1 << 15
#: The sample that the model is fitted on: about so many documents of each language, by a hash of the id.
TRAIN_DOCS = 2000
#: More languages than this are an error (the model takes 256 kB each on every executor).
MOST_LANGUAGES = 512
ROUNDS = 12
#: What one more language must add to the log likelihood, a trigram draw; dependent draws need more than a BIC.
PENALTY = 0.02
SMOOTHING = 0.5

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x110000)), bool, 0x110000)
    return _letters


def trigrams(text: str) -> np.ndarray:
    """Bucket of the three characters around every letter, others than letters as space; lower case."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letter = letters()[points]
    points = np.where(letter, points, np.uint32(32)).astype(np.uint64)
    packed = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]
    return (mix(packed[letter[1:-1]]) % np.uint64(BUCKETS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            found = np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
            if lang in sums:
                sums[lang] += found
            else:
                sums[lang] = found
    for lang, counts in sums.items():
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram probabilities (languages x buckets), from non-null text and lang of rows outside the held-out fold."""
    rows = docs.filter("text is not null and lang is not null").filter(F.coalesce(remainder("doc_id", 5), F.lit(1)) != 0)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"at most {MOST_LANGUAGES} languages")
    part = F.lit(0.0)
    for lang, n in sizes.items():
        part = F.when(F.col("lang") == lang, F.lit(min(1.0, train_docs / n))).otherwise(part)
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(4)), F.lit(1 << 20)) / (1 << 20)
    counted = rows.filter(place < part).select("lang", "text").mapInArrow(_counts, "lang string, bucket long, n long")
    # Summed over all tasks before they come here: at most BUCKETS numbers a language.
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    sums = {lang: np.zeros(BUCKETS, np.int64) for lang in sorted(sizes)}
    names, at, n = (found[c].to_numpy() for c in ("lang", "bucket", "n"))
    for lang in sums:
        mine = names == lang
        sums[lang][at[mine]] = n[mine]
    langs = [lang for lang, c in sums.items() if c.any()]
    table = np.array([sums[lang] + SMOOTHING for lang in langs], np.float64).reshape(len(langs), BUCKETS)
    return langs, table / table.sum(axis=1, keepdims=True) if len(langs) else table


def proportions(probs: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Mixture weights by expectation-maximisation, and the log likelihood a draw. probs: draws x languages."""
    total = counts.sum()
    weights = np.full(probs.shape[1], 1.0 / probs.shape[1])
    for _ in range(rounds):
        share = counts / (probs @ weights)
        weights = weights * (share @ probs) / total
    return weights, float(counts @ np.log(probs @ weights) / total)


def infer(table: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Proportion of each language in a text with these trigram buckets (at least one)."""
    counts = np.bincount(draws, minlength=1)
    used = np.flatnonzero(counts)
    counts, probs = counts[used].astype(np.float64), table[:, used].T
    out = np.zeros(len(table))
    single = counts @ np.log(probs) / counts.sum()
    best = int(single.argmax())
    out[best] = 1.0
    if len(table) == 1:
        return out
    weights, likelihood = proportions(probs, counts)
    if likelihood - single[best] <= PENALTY:
        return out
    order = np.argsort(-weights, kind="stable")
    order = np.concatenate([[best], order[order != best]])
    score = single[best]
    for k in range(2, len(order) + 1):
        weights, likelihood = proportions(probs[:, order[:k]], counts)
        if likelihood - PENALTY * (k - 1) <= score:
            break
        score = likelihood - PENALTY * (k - 1)
        out[:] = 0
        out[order[:k]] = weights
    return out


def languages(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (its proportion), proportions (by language).

    held_out: crc32 of the id as text is 0 modulo 5 (a null id isn't held out). A text that is null or
    has no letter is ``und`` with score 0, as is every text when there is nothing to learn from. The
    largest proportion wins, of equal ones the first name. Long texts count whole; repeated rows are
    judged alike; an empty table gives no rows; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, train_docs))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = model.value
        for batch in batches:
            names, scores, maps = [], [], []
            for text in batch.column("text"):
                draws = trigrams(text.as_py()) if text.is_valid and langs else ()
                if not len(draws):
                    names.append("und")
                    scores.append(0.0)
                    maps.append([])
                    continue
                found = infer(table, draws)
                best = int(found.argmax())
                names.append(langs[best])
                scores.append(min(1.0, float(found[best])))
                maps.append([(langs[i], float(found[i])) for i in np.flatnonzero(found)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(maps, pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "held_out", "lang_pred", "score", "proportions"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, proportions map<string,double>")


def op4_mixture_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(documents(spark, sf_dir)).drop("proportions")
