import hashlib
import re

from helpers import awkward, empty, table
from pyspark.sql import functions as F

from trailstat.llm import exact_dedup as e
from trailstat.llm.common import new_path, spool


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups = {}
    for r, t in zip(rows, norm):
        groups.setdefault(t, []).append(r[0])
    least = {t: min([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    return sorted(((r[0] is None, r[0] or 0, least[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(rows, norm)), key=str)


def seen(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    got = e.exact_dedup(table(spark))
    assert seen(got) == brute(awkward())
    per = got.groupBy("text_sha256").agg(F.count_if("kept").alias("k")).collect()
    assert all(r["k"] == 1 for r in per)


def test_weak_digest_is_settled_by_full_bytes(spark):
    got = e.exact_dedup(table(spark), digest=lambda t: (F.length(t) % 3).cast("string"), files_per_trigger=1)
    assert seen(got) == brute(awkward())


def test_state_goes_on_with_new_files(spark):
    path = new_path(spark, "stream-test")
    state = new_path(spark, "state-test")
    for rows in ([(5, "f", 0, "d1"), (3, "f", 1, "d2")], [(2, "g", 0, "d1"), (9, "g", 1, "d1")]):
        spark.createDataFrame(rows, "doc_id long, file string, row long, digest string").coalesce(1).write.mode("append").parquet(path)
        e.update_state(spark.read.parquet(path), state)
    got = {r["digest"]: (r["first"]["doc_id"], r["first"]["file"], r["n"]) for r in e.read_state(spark, state).collect()}
    assert got == {"d1": (2, "g", 3), "d2": (3, "f", 1)}


def test_distinct_documents_as_they_came(spark):
    docs = spool(table(spark), "t")
    got = e.distinct_documents(docs)
    assert got.columns == docs.columns
    assert got.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in awkward()})


def test_rows_come_as_they_were_whatever_columns_are_called(spark):
    names = ["doc_id", "text", "_file", "_at", "_row", "_metadata", "a.b", "file", "row", "digest", "kept"]
    rows = [(i, t, *(f"{n}{i}" for n in names[2:])) for i, t in enumerate(["a b", "a  b", None, "", "c", "a\tb"])]
    docs = spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    for d in (docs, spool(docs, "t")):
        got = e.distinct_documents(d)
        assert got.columns == names and sorted(map(str, map(tuple, got.collect()))) == sorted(str(rows[i]) for i in (0, 2, 4))


def test_no_setting_of_the_session_changes(spark):
    before = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    e.exact_dedup(table(spark)).count()
    assert {r["key"]: r["value"] for r in spark.sql("SET").collect()} == before


def test_empty_table(spark):
    assert e.exact_dedup(empty(spark)).count() == 0
