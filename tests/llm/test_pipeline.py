import os

import pytest
from helpers import awkward, empty, table

import __spark_entry__
import corpus_pipeline
from trailstat.llm import registry
from trailstat.llm.common import shared_root, spool

TABLES = "/root/testdata/sf0.001"


def test_each_stage_does_its_part(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.spool(stage(spark, docs, TABLES), f"test-{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] > 0
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, TABLES)
    assert {r["doc_id"] for r in packed.collect()} == ids
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, TABLES).collect()} == ids


CLEAN = " ".join("word" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(200))


def test_awkward_rows_pass_through_all_stages(spark):
    more = [(50, CLEAN, "en", "s0", 1), (51, CLEAN.replace(" ", "  "), None, None, None), (None, CLEAN + " end", None, "s1", None), (52, CLEAN.replace("worda", "wordz", 1), "en", "s1", 1), (52, CLEAN[::-1], "en", "s1", 1), (53, CLEAN.upper().lower() * 40, None, None, None)]
    docs = table(spark, awkward() + [(*r, "extra", "clash", "shard") for r in more])
    packed = corpus_pipeline.run_over(spark, docs, TABLES).collect()
    # 50 to 52 hold one text, or nearly so; the row without an id stays, 53 repeats its windows, and of the awkward rows none has 50 clean words but the long ones.
    ids = {r["doc_id"] for r in packed}
    assert {50, None, 52} <= ids and not ids & {0, 1, 2, 3, 4, 5, 6, 9, 10, 11, 12, 51, 53}


@pytest.mark.parametrize("spooled", [False, True])
def test_any_names_and_no_rows(spark, spooled):
    names = ["doc_id", "text", "source", "_row", "_file", "_at", "_place", "_position", "_metadata", "_words", "a.b", "position", "kept"]
    rows = [(i, CLEAN[i * 40 :], f"s{i % 2}", *(f"{n}{i}" for n in names[3:])) for i in range(5)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
        docs = spool(docs, "t") if spooled else docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, TABLES)
            assert out.columns == names and set(map(tuple, out.collect())) <= set(rows) and bool(out.count()) == bool(some)
    assert corpus_pipeline.run_over(spark, empty(spark), TABLES).count() == 0


def test_nothing_is_left_behind_but_what_the_result_reads(spark):
    root = shared_root(spark).removeprefix("file://") + "/trailstat"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    packed = corpus_pipeline.run(spark, TABLES)
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before} == {"pack-slots"} and packed.count()


def test_all_ten_are_registered():
    names = sorted(int(n.split("_")[0][2:]) for n in registry.queries())
    assert names == list(range(1, 11))
    assert set(registry.queries()) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
