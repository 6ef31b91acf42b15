"""Small tables with the cases that every operator has to bear."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, shard string"
LONG = " ".join(f"w{i % 977}x{i % 53}" for i in range(60_000))


def awkward():
    """Nulls in any column, empty and blank texts, one word, ties, repeated rows, a long text, odd characters."""
    texts = [None, "", "   \n\t ", "one", "one two  three\nfour", "one two three four", "One\x0bTWO\x0cthree four", LONG, LONG + " end", "日本語 テキスト é", "a\x00b   c", "!!! ### $$$", "the " * 80]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None) for i, t in enumerate(texts)]
    rows += [(3, "one", "en", "s1", 3), (3, "one", "en", "s1", 3), (None, "one", None, None, None), (None, None, None, None, None), (4, "another text of the same id", "de", "s0", 1)]
    return [(*r, "extra", "clash", "shard") for r in rows]


def table(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, lower=True):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in found] if lower else found
