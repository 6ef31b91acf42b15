import random

import numpy as np
from helpers import awkward, empty, table, words

from trailstat.llm import neardup as n
from trailstat.llm.common import shared_root, spool
from trailstat.llm.components import components
from trailstat.llm.textkit import shingles


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """(doc_id, set size) to component, by all pairs."""
    sets = [shingle_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 75 * (len(a) + len(sets[j]) - both) and sets[j]:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0] is None, r[0] or 0, len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=str)


def seen(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def planted(seed, n_groups=12):
    rng = random.Random(seed)
    common = [f"p{i}" for i in range(30)]
    rows, at = [], 0
    for g in range(n_groups):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(rng.randrange(30, 160))]
        for _ in range(rng.choice([1, 2, 3, 40 if g == 0 else 4])):
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.4:
                text = common + text
            rows.append((at, " ".join(text), None, None, None, "", "", ""))
            at += 1
    rng.shuffle(rows)
    return rows


def test_groups_with_edits_and_a_common_passage(spark):
    rows = planted(1)
    assert seen(n.near_dedup(table(spark, rows))) == brute(rows)


def test_small_blocks_and_shuffled_ids_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK", 7)
    monkeypatch.setattr(n, "WIDE_BLOCK", 11)
    monkeypatch.setattr(n, "PIVOTS", 1)
    monkeypatch.setattr(n, "BROADCAST_IDS", 0)
    rows = planted(2)
    assert seen(n.near_dedup(table(spark, rows))) == brute(rows)


def test_two_followers_of_a_leader_that_follows_another(spark):
    rng = random.Random(5)
    rows = []
    for g in range(30):
        fresh = lambda n, g=g: [f"g{g}w{rng.randrange(10**9)}" for _ in range(n)]
        shared, second, third = fresh(80), fresh(60), fresh(60)
        a = shared + fresh(5)
        b = a[:-3] + fresh(3)
        texts = [a, b, shared + second, second + third, second + third + fresh(4), third + fresh(10), third + fresh(12)]
        rows += [(len(rows) + i, " ".join(t), None, None, None, "", "", "") for i, t in enumerate(texts)]
    assert seen(n.near_dedup(table(spark, rows))) == brute(rows)


def brute_by_matrix(rows):
    """Components as ``brute`` has them, for thousands of texts with words: by one product of matrices."""
    sets = [shingle_set(r[1]) for r in rows]
    number = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(rows), len(number)), np.float32)
    for i, s in enumerate(sets):
        has[i, [number[x] for x in s]] = 1
    both, size = has @ has.T, has.sum(axis=1)
    links = 100 * both >= 75 * (size[:, None] + size[None, :] - both)
    least = np.array([r[0] for r in rows])
    while True:
        new = np.where(links, least[None, :], 1 << 60).min(axis=1)
        if (new == least).all():
            return {r[0]: int(c) for r, c in zip(rows, least)}, links
        least = new


def test_two_thousand_copies_around_several_leaders(spark):
    rng = random.Random(11)
    passage = [f"c{i}" for i in range(60)]
    texts = []
    for g in range(4):
        # Copies with up to 8 edits: many are too far from the middle and from each other, and link through others.
        base = passage + [f"g{g}w{i}" for i in range(60)]
        texts += [[f"e{rng.randrange(60)}" if i in edits else w for i, w in enumerate(base)] for edits in ({rng.randrange(120) for _ in range(rng.randrange(9))} for _ in range(500))]
    rows = [(i, " ".join(t), None, None, None, "", "", "") for i, t in enumerate(rng.sample(texts, len(texts)))]
    want, links = brute_by_matrix(rows)
    assert 4 < len(set(want.values())) < 1500 and not links[0].all()
    got = {r["doc_id"]: r["component_id"] for r in n.near_dedup(table(spark, rows)).collect()}
    assert got == want


def test_a_passage_that_most_of_a_text_is_made_of(spark):
    rng = random.Random(12)
    passage = [f"c{i}" for i in range(70)]
    texts = [passage + [f"w{rng.randrange(10**9)}" for _ in range(40)] for _ in range(400)]
    texts += [[*t[:-2], "other", "end"] for t in texts[::10]]
    rows = [(i, " ".join(t), None, None, None, "", "", "") for i, t in enumerate(texts)]
    want, _ = brute_by_matrix(rows)
    assert len(set(want.values())) == 400
    assert {r["doc_id"]: r["component_id"] for r in n.near_dedup(table(spark, rows)).collect()} == want


def test_rows_come_as_they_were_whatever_columns_are_called(spark):
    names = ["doc_id", "text", "lang", "_place", "place", "_row", "_metadata", "a.b", "class", "part", "file"]
    rows = [(r[0], r[1], r[2], *(f"{n}{i}" for n in names[3:])) for i, r in enumerate(awkward())]
    docs = spark.createDataFrame(rows, ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    for d in (docs, spool(docs, "t")):
        got = n.unlike_documents(d)
        assert got.columns == names
        kept = {(r["doc_id"], r["n_shingles"]) for r in n.near_dedup(docs).filter("kept").collect()}
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(r) for r in rows if (r[0], len(shingle_set(r[1]))) in kept)


def test_nothing_is_left_behind_but_what_the_result_reads(spark):
    import os

    root = shared_root(spark).removeprefix("file://") + "/trailstat"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    rows = n.near_dedup(table(spark, planted(3, 4)))
    assert rows.count() and {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before} == {"near-docs", "near-features", "near-named"}


def test_shingles_of_few_words():
    rng = np.random.default_rng(0)
    for total in range(6):
        hashes = rng.integers(0, 1 << 63, total).astype(np.uint64)
        for first in ([0, total], [0, 0, total, total], [0, total // 2, total]):
            got, begin = shingles(hashes, np.array(first), 5)
            sizes = [max(1, c - 4) if c else 0 for c in np.diff(first)]
            assert begin.tolist() == [0, *np.cumsum(sizes)] and len(got) == sum(sizes)
            for i in range(len(sizes)):
                alone, _ = shingles(np.concatenate([hashes[first[i] : first[i + 1]], hashes, hashes[:1].repeat(5)]), np.array([0, first[i + 1] - first[i]]), 5)
                assert (alone == got[begin[i] : begin[i + 1]]).all()


def test_a_text_without_an_id_links_as_others_do(spark):
    base = [f"w{i}" for i in range(80)]
    edit = lambda *at: " ".join("e" + w if i in at else w for i, w in enumerate(base))
    # The two documents are too far from each other, and near the text without an id between them.
    texts = [(1, edit(0, 10)), (2, edit(60, 79)), (None, edit()), (None, "Other " + edit()), (3, "far from all of them")]
    rows = [(i, t, None, None, None, "", "", "") for i, t in texts]
    got = seen(n.near_dedup(table(spark, rows)))
    assert got == brute(rows) and {r[3] for r in got} == {1, 3}
    assert brute(rows[:2]) != brute(rows)[:2]


def test_awkward_rows(spark):
    got = n.near_dedup(table(spark))
    # Rows of one id are one document for linking; here each of their texts is judged.
    assert seen(got) == brute(awkward())
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got.collect())


def test_signature_collisions_estimate_similarity():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = n.shingle_set(x[:2500]), n.shingle_set(x[500:])
    collisions = (n.signature(a) == n.signature(b)).mean()
    assert abs(collisions - 2000 / 3000) < 0.2
    assert (n.signature(a, chunk=100) == n.signature(a)).all()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(links, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}


def test_empty_table(spark):
    assert n.near_dedup(empty(spark)).count() == 0
