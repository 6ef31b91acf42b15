"""Quality rules as a short-circuit cascade of native expressions.

Each rule's cost and rejection rate are estimated on a sample; rules then run in the order of
rejection per cost, and a document that one rule rejects skips the rest. The order changes only the
time taken and which rule is named, never the verdict. Where documents are only accepted or not, each
count is made inside the rules that need it, so the costly ones (repeated windows) see what is left.
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, documents, relation_paths, whole_row

SYMBOLS = "#*$%&|<>"
#: Positions of windows are packed beside 42 bits of hash; longer texts take the exact path for all windows.
PLACE_BITS = 22


@dataclass(frozen=True)
class Rule:
    """``rejects``: a native boolean expression over text and the base counts, true where the rule rejects."""

    name: str
    rejects: str


#: Over ``text`` (never null here) and n_words, word_chars, n_symbols, n_dup_lines. Plain functions that mean the same in DuckDB.
RULES = (
    Rule("symbols_per_word", "10 * n_symbols > n_words"),
    Rule("mean_word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("exclamation_marks", "5 * (length(text) - length(replace(text, '!', ''))) > n_words"),
    Rule("capital_letters", "10 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * word_chars"),
    Rule("digits", "10 * (length(text) - length(translate(text, '0123456789', ''))) > 3 * word_chars"),
    Rule("ellipses", "10 * (length(text) - length(replace(text, '...', ''))) > 3 * n_words"),
)

MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: The base, as rules over n_words and n_repeat_words.
BASE_RULES = (Rule("few_words", f"n_words < {MIN_WORDS}"), Rule("repeated_windows", f"100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words"))


def _repeated_words(words: str) -> str:
    """Words in 3-word windows that occur twice or more, counted without leaving the row.

    Windows are packed as (hash, place) longs and sorted: equal windows stand side by side, so those
    with an equal neighbour are candidates (usually none). Only candidates are compared as texts, again
    by sorting, and the words that the equal ones cover are summed from the gaps between their places.
    """
    gram = lambda i: f"{words}[{i}], ' ', {words}[{i} + 1], ' ', {words}[{i} + 2]"
    mask = (1 << PLACE_BITS) - 1
    packed = f"""sort_array(transform(sequence(0, size({words}) - 3), i -> (xxhash64({gram('i')}) & {~mask}L) | i))"""
    return f"""
    CASE WHEN size({words}) < 4 THEN 0L ELSE (
      transform(array({packed}), s ->
        transform(array(CASE WHEN size({words}) > {mask} THEN sequence(0, size({words}) - 3) ELSE
            transform(filter(s, (x, i) -> (i > 0 AND (x ^ s[greatest(i - 1, 0)]) BETWEEN 0 AND {mask}) OR (i < size(s) - 1 AND (x ^ s[least(i + 1, size(s) - 1)]) BETWEEN 0 AND {mask})), x -> cast(x & {mask} AS int)) END), c ->
          CASE WHEN size(c) < 2 THEN 0L ELSE
          transform(array(sort_array(transform(c, p -> struct(concat({gram('p')}) AS g, p AS p)))), t ->
            transform(array(sort_array(transform(filter(t, (x, i) -> (i > 0 AND x.g = t[greatest(i - 1, 0)].g) OR (i < size(t) - 1 AND x.g = t[least(i + 1, size(t) - 1)].g)), x -> x.p))), q ->
              aggregate(transform(q, (p, i) -> CASE WHEN i = size(q) - 1 THEN 3 ELSE least(3, q[least(i + 1, size(q) - 1)] - p) END), 0L, (a, x) -> a + x))[0])[0] END)[0])[0]) END"""


def _counts(text: str = "text", words: str = "_words", lines: str = "_lines") -> dict[str, str]:
    """The base counts as expressions over a text, its words and its lines that hold a word."""
    return {
        "n_words": f"cast(size({words}) AS bigint)",
        "word_chars": f"cast(length(array_join({words}, '')) AS bigint)",
        "n_symbols": f"cast(regexp_count({text}, '[{SYMBOLS}]') AS bigint)",
        "n_dup_lines": f"cast(size({lines}) - size(array_distinct({lines})) AS bigint)",
        "n_lines": f"cast(size({lines}) AS bigint)",
        "n_repeat_words": f"cast({_repeated_words(words)} AS bigint)",
    }


def _parts(docs: DataFrame, row: bool = False) -> DataFrame:
    """doc_id, text (null: empty), _words, _lines; with ``row`` also the row as it came, as the struct _row."""
    whole = [whole_row(docs).alias("_row")] if row else []
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *whole)
    body = F.btrim(F.col("text"), F.lit(SPACES))
    # A row number is no function of the row: so the optimiser can't copy the splitting to where words are used, which would split the text again for every window.
    once = F.monotonically_increasing_id() >= 0
    return base.select(
        "*",
        F.when(once & (body != ""), F.split(body, SPACE_RUN)).otherwise(F.array().cast("array<string>")).alias("_words"),
        F.when(once, F.filter(F.split(F.col("text"), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")).alias("_lines"),
    )


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the base counts; see ``quality_cascade`` for what each counts."""
    return _parts(docs).select("doc_id", "text", *[F.expr(e).alias(name) for name, e in _counts().items()])


def _inlined(rejects: str) -> Column:
    """A rule's expression over the parts of a text, each count made where the rule uses it."""
    for name, count in _counts().items():
        rejects = re.sub(rf"\b{name}\b", lambda _, count=count: f"({count})", rejects)
    return F.expr(rejects)


def sample_of(docs: DataFrame, rows: int, files: int = 8, seed: int = 1) -> DataFrame:
    """About ``rows`` documents at random: of at most ``files`` files drawn at random where ``docs`` is a plain table."""
    if relation_paths(docs) and (names := sorted(docs.inputFiles())):
        docs = docs.sparkSession.read.schema(docs.schema).parquet(*random.Random(seed).sample(names, min(files, len(names))))
    n = docs.count()  # of a plain table, from the files' footers
    return docs.sample(min(1.0, 2 * rows / max(1, n)), seed).limit(rows)


def rule_order(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 400, repeats: int = 8) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) on a sample, by rejection per cost, highest first; ties by name.

    A rule's seconds are those of counting what it rejects of the sample, taken ``repeats`` times in one
    job so that the job itself weighs little, less those of a job that judges nothing. Bounded by
    ``sample_rows``; used for the order alone.
    """
    # All of it in one task: what is timed is the rule, not how its rows are dealt out.
    sample = _parts(sample_of(docs, sample_rows)).coalesce(1).persist()
    try:
        n = max(1, sample.count())
        many = sample.join(F.broadcast(docs.sparkSession.range(repeats).withColumnRenamed("id", "_time")))  # ``repeats`` rows

        def timed(rejects: Column) -> tuple[float, float]:
            # The time's number makes each evaluation one of its own.
            counted = many.agg(F.count_if(rejects & (F.col("_time") >= 0)).alias("n"))
            rejected = counted.first()["n"]
            began = time.perf_counter()
            counted.first()
            return time.perf_counter() - began, rejected / (n * repeats)

        nothing, _ = timed(F.col("doc_id") < 0)
        found = [(rule, max(1e-6, seconds - nothing), share) for rule in rules for seconds, share in [timed(_inlined(rule.rejects))]]
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def quality_cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, order: Sequence[Rule] | None = None) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, rejected_by (the base, or the first rule that rejects).

    Words are runs of characters other than space and U+0009 to U+000D. word_chars: code points in
    words. n_symbols: characters of ``#*$%&|<>``. n_dup_lines: lines with a word that equal an earlier
    one. n_repeat_words: words in 3-word windows that the text holds twice or more.
    A null or empty text has no words and so fails the base; a very long one is read whole; repeated
    rows are judged alike, each on its own; an empty table gives no rows; other columns are ignored.
    The counts are part of the result, so they are made for every document; the rules over them short-circuit.
    """
    order = list(order) if order is not None else [x[0] for x in rule_order(docs, rules)]
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for rule in order:
        verdict = verdict.when(F.expr(rule.rejects), F.lit(rule.name))
    failed = F.expr(" OR ".join(f"({r.rejects})" for r in BASE_RULES))
    judged = with_base(docs).withColumn("base_failed", failed).withColumn("rejected_by", verdict)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def accepted_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, order: Sequence[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that ``quality_cascade`` keeps, as they came, whatever their columns are called.

    The base's conditions are rules of the cascade like the others, and each count is made by the first
    rule that needs it of a document: one that an earlier rule rejects costs no more.
    """
    order = list(order) if order is not None else [x[0] for x in rule_order(docs, (*BASE_RULES, *rules))]
    verdict = F.lit(False)
    for rule in reversed(order):
        verdict = F.when(_inlined(rule.rejects), True).otherwise(verdict)
    return _parts(docs, row=True).filter(~verdict).select("_row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade(documents(spark, sf_dir)).drop("rejected_by")


def _oracle() -> str:
    rejects = " OR ".join(f"({r.rejects})" for r in RULES)
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT rid, unnest(range(1, len(words) - 1)) AS p, words FROM w WHERE len(words) > 2),
h AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, words[p], words[p + 1], words[p + 2]) AS c FROM g),
r AS (SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, p + unnest([0, 1, 2]) AS q FROM h WHERE c > 1) GROUP BY rid),
b AS (SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {rejects}) AS kept FROM f"""


ORACLE = {"op1_quality_rules": _oracle()}
