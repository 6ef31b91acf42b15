from collections import Counter
from fractions import Fraction

import pytest
from helpers import awkward, empty, table

from trailstat.llm import mixing as m
from trailstat.llm.common import spool


def test_a_million_slots_stay_within_a_block_of_the_given_weights():
    weights = {"a": Fraction(1, 3), "b": Fraction(1, 7), "c": Fraction(11, 21) - Fraction(1, 10**4), "d": Fraction(1, 10**4)}
    assert sum(weights.values()) == 1
    whole = m.whole_weights(weights)
    total, done = sum(whole.values()), dict.fromkeys(weights, 0)
    for t, (s, i, release, deadline) in zip(range(1, 10**6 + 1), m.pfair(dict.fromkeys(weights, 10**9), weights)):
        assert i == done[s] and release < t <= deadline
        done[s] += 1
        if t % 7 == 0 or t > 10**6 - 100:
            assert all(abs(done[x] * total - whole[x] * t) < total for x in weights)
    assert done["d"] == 100


def test_positions(spark):
    got = m.mix_positions(table(spark), block_rows=2).collect()
    assert sorted(r["position"] for r in got) == list(range(len(awkward())))
    assert Counter(r["source"] for r in got) == Counter(r[3] for r in awkward())
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    by_source = {}
    for r in sorted(got, key=lambda r: r["position"]):
        by_source.setdefault(r["source"], []).append(r["source_row"])
    assert all(v == list(range(len(v))) for v in by_source.values())


def test_no_source_strays_a_block_from_the_given_weights(spark):
    weights = {"hot": 100, **{f"s{i:03}": 1 for i in range(200)}}
    rows = [(None, "", None, s, None, "", "", "") for s, w in weights.items() for _ in range(6 * w)]
    order = [r["source"] for r in sorted(m.mix_positions(table(spark, rows), weights, block_rows=1).collect(), key=lambda r: r["position"])]
    done = Counter()
    for t, s in enumerate(order, 1):
        done[s] += 1
        assert all(abs(done[x] - Fraction(t * weights[x], 300)) < 1 for x in ("hot", s))
    assert done == {s: 6 * w for s, w in weights.items()}


def test_thousands_of_sources(spark):
    rows = [(i, "", None, f"host{i % 2000}" if i % 3 else "host0", None, "", "", "") for i in range(5000)]
    got = m.mix_positions(table(spark, rows), block_rows=2).collect()
    assert sorted(r["position"] for r in got) == list(range(5000)) and {r["doc_id"] for r in got} == set(range(5000))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)


@pytest.mark.parametrize("weights", [{"a": 1e-5, "b": 0.7, None: 0.3}, {str(i): (i % 7 + 1) ** 0.7 for i in range(60)}, {"a": Fraction(1, 3), "b": Fraction(2, 3)}])
def test_exact_windows_and_lag_as_sources_run_out(weights):
    blocks = {s: 300 + 997 * k % 601 for k, s in enumerate(weights)}
    exact = {s: Fraction(w) for s, w in weights.items()}
    fluid, done, t = dict.fromkeys(blocks, Fraction(0)), Counter(), 0
    for t, (s, i, release, deadline) in enumerate(m.pfair(blocks, weights)):
        assert i == done[s] and release <= t < deadline
        done[s] += 1
        step = Fraction(1)
        while step:
            live = [x for x in blocks if fluid[x] < blocks[x]]
            total = sum(exact[x] for x in live)
            part = min(step, *[(blocks[x] - fluid[x]) * total / exact[x] for x in live])
            for x in live:
                fluid[x] += part * exact[x] / total
            step -= part
        assert all(abs(done[x] - fluid[x]) < 1 for x in blocks)
        if t > 2500:
            return
    assert done == blocks


def test_documents_come_whole_in_mixed_order(spark):
    docs = spool(table(spark).dropDuplicates(), "t")
    mixed = m.mixed_documents(docs, block_rows=2)
    assert mixed.columns == docs.columns and sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect()))


def test_rows_come_as_they_were_whatever_columns_are_called(spark):
    names = ["doc_id", "source", "position", "_position", "_file", "_at", "_row", "_metadata", "a.b", "file", "row", "h", "block"]
    rows = [(i % 5 if i else None, f"s{i % 3}" if i % 4 else None, *(f"{n}{i}" for n in names[2:])) for i in range(40)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    for d in (docs, spool(docs, "t")):
        got = m.mixed_documents(d, block_rows=2)
        assert got.columns == names and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows))


def test_equal_ids_come_in_the_order_of_their_rows(spark):
    docs = spool(spark.createDataFrame([(7, f"t{i}", None, "s", None, "", "", "") for i in range(50)], table(spark).schema).coalesce(1), "t")
    assert [r["text"] for r in m.mixed_documents(docs, block_rows=4).collect()] == [f"t{i}" for i in range(50)]


def test_weights_must_cover_the_sources(spark):
    with pytest.raises(ValueError):
        m.mix_positions(table(spark), weights={"s0": 1.0})


def test_empty_table(spark):
    assert m.mix_positions(empty(spark)).count() == 0 and m.mixed_documents(empty(spark)).count() == 0
