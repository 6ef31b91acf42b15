import zlib

import numpy as np
from helpers import awkward, empty, table

from trailstat.llm import sharding as s


def jump(key, n):
    """The published loop, one key at a time."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_equals_the_published_loop():
    keys = [0, 1, 2, 99, -1, 2**62, *range(1000, 1500)]
    for n in (1, 2, 16, 17, 1000):
        assert s.jump_hash(np.array(keys, np.int64), n).tolist() == [jump(k, n) for k in keys]


def test_one_more_shard_takes_rows_only_into_itself():
    keys = np.arange(50_000)
    old, new = s.jump_hash(keys, 16), s.jump_hash(keys, 17)
    moved = old != new
    assert set(new[moved]) == {16} and abs(moved.mean() - 1 / 17) < 0.005
    assert np.bincount(old).min() > 0.9 * len(keys) / 16


def test_rows(spark):
    got = s.shard_documents(table(spark), 4).collect()
    raw = lambda t: (t or "").encode()
    want = sorted((str(r[0]), len(raw(r[1])) + 1, zlib.crc32(raw(r[1])), jump(-1 if r[0] is None else r[0], 4)) for r in awkward())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"], r["shard"]) for r in got) == want
    for shard in range(4):
        mine = sorted((r["slot"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got if r["shard"] == shard)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1] for m in mine] == sorted(m[1] for m in mine)


def test_empty_table(spark):
    assert s.shard_documents(empty(spark)).count() == 0
