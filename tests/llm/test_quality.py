from collections import Counter

from helpers import awkward, empty, table, words
from hypothesis import given, settings
from hypothesis import strategies as st

from trailstat.llm import quality
from trailstat.llm.common import spool


def brute(text):
    text = text or ""
    w = words(text, lower=False)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def check(spark, texts):
    rows = [(i, t, None, None, None, "", "", "") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in quality.quality_cascade(table(spark, rows), order=quality.RULES).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in BASE) == brute(t), repr(t)


def test_base_counts_equal_brute_force(spark):
    check(spark, [r[1] for r in awkward()] + ["a b c a b c", "a b c d a b c", "a a a a", "a a a", "x\nx\n\nx", "ab " * 500 + "cd", "a b c x a b c y a b c", "a b a b a b a"])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="ab# \n\t\x0b|é", max_size=60), min_size=1, max_size=30))
def test_base_counts_on_random_texts(spark, texts):
    check(spark, texts)


def test_order_changes_no_verdict(spark):
    docs = table(spark)
    found = [sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["kept"]) for r in quality.quality_cascade(docs, order=o).collect()) for o in (quality.RULES, quality.RULES[::-1], None)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(awkward())


def test_rules_are_ordered_by_rejection_per_cost(spark):
    order = quality.rule_order(table(spark))
    score = [share / max(cost, 1e-9) for _, cost, share in order]
    assert score == sorted(score, reverse=True) and {r.name for r, _, _ in order} == {r.name for r in quality.RULES}


def test_accepted_documents_keep_their_columns(spark):
    clean = " ".join("word" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(60))
    docs = table(spark, [(1, clean, "en", "s", 1, "x", "y", "z"), (2, clean + " ###" * 60, "en", "s", 1, "x", "y", "z"), (3, None, None, None, None, None, None, None)])
    got = quality.accepted_documents(docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, clean, "en", "s", 1, "x", "y", "z")]


def test_accepted_are_those_that_the_cascade_keeps_in_any_order(spark):
    texts = [r[1] for r in awkward()] + [" ".join(f"{'Ab' if i % 2 else 'word'}{i % m}" for i in range(80)) for m in (3, 30, 80)] + ["x! " * 70, "1234 abcd efgh " * 30, "a b c\n" * 30]
    texts += [" ".join("word" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(n)) for n in (60, 49)]
    docs = table(spark, [(i, t, None, None, None, "", "", "") for i, t in enumerate(texts)])
    kept = {r["doc_id"] for r in quality.quality_cascade(docs, order=quality.RULES).filter("kept").collect()}
    assert kept and len(kept) < len(texts)
    every = (*quality.BASE_RULES, *quality.RULES)
    for order in (every, every[::-1], None):
        assert {r["doc_id"] for r in quality.accepted_documents(docs, order=order).collect()} == kept


def test_rows_come_as_they_were_whatever_columns_are_called(spark):
    names = ["doc_id", "text", "_row", "_lines", "_words", "a.b", "n_words", "_metadata", "_time"]
    clean = " ".join("word" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(60))
    rows = [(1, clean, *names[2:]), (2, "few", *names[2:])]
    docs = spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    for d in (docs, spool(docs, "t")):
        got = quality.accepted_documents(d)
        assert got.columns == names and [tuple(r) for r in got.collect()] == rows[:1]


def test_main_path_is_native(spark):
    accepted = quality.accepted_documents(table(spark), order=(*quality.BASE_RULES, *quality.RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in accepted and "Arrow" not in accepted
    plan = quality.quality_cascade(table(spark), order=quality.RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    assert quality.quality_cascade(empty(spark)).count() == 0
