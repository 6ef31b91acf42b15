"""Near duplicates by a signature-coordinate inverted join.

Documents are posted under each (coordinate, value) pair of their MinHash signature. Two documents are
candidates when they collide in at least MATCHES of COORDINATES postings. Prefix and skip merging: with
a document's postings ordered from rare to frequent, its MATCHES - 1 most frequent ones are skipped, as
two documents with enough collisions meet in what is left of both. Postings that nobody shares need no
list, so a document with fewer than MATCHES shared postings is done. Candidates are confirmed on their
full shingle sets.

Large groups are never expanded into all pairs. Each list has a leader (the member whose postings are
the most common, so the middle of a group of copies), and a leader's lists make up its neighbourhood: two
documents that share a posting share a neighbourhood. Documents are compared with a leader, with all
their leaders, and with a few members of the largest component around a leader, each time only as far as
they are still in different components. In the neighbourhoods that then hold several components,
collisions of those outside the largest one are counted block by block, on signatures; those with enough
of them are compared on their sets, again in blocks, which return no more links than they have documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, passing, place, spool, stored, whole_row
from .components import components
from .textkit import Words, mix, pieces, shingles

SHINGLE = 5
SIMILAR_PERCENT = 75
COORDINATES = 64
#: At a similarity of 0.75 a pair has fewer matches than this with a chance of about 1 in 200,000.
MATCHES = 32
#: Documents of a block whose sets are compared, and of one whose signatures are.
BLOCK, WIDE_BLOCK = 512, 1024
#: Members of the largest component around a leader that the others are compared with before any block is.
PIVOTS = 8
#: Places of rows up to this many are sent to all executors (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000

_ORDER = (mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_FLIP = (mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) + np.uint64(1 << 40)) >> np.uint64(32)).astype(np.uint32)
_NAME = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) + np.uint64(1 << 50))


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    out = np.sort(hashes)
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


def signature(shingle_hashes: np.ndarray, chunk: int = 4096) -> np.ndarray:
    """For each coordinate the posting (a 64-bit name of coordinate and value) of the set's least element in that coordinate's order."""
    best = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    least = np.full(COORDINATES, shingle_hashes[0], np.uint64)
    for at in range(0, len(shingle_hashes), chunk):
        part = shingle_hashes[at : at + chunk]
        ranks = ((part >> np.uint64(32)).astype(np.uint32)[None, :] ^ _FLIP[:, None]) * _ORDER[:, None]
        where = ranks.argmin(axis=1)
        rank = ranks[np.arange(COORDINATES), where]
        better = (rank < best) | ((rank == best) & (part[where] < least)) if at else np.ones(COORDINATES, bool)
        best, least = np.where(better, rank, best), np.where(better, part[where], least)
    return mix(least ^ _NAME).view(np.int64)


def class_of(shingle_hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingle_hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(batches: Iterator[pa.RecordBatch]):
    for batch, data, offsets in pieces(batches, max_bytes=1 << 20):
        words = Words(data, offsets)
        hashes, begin = shingles(words.hashes(lower=True), words.first, SHINGLE)
        yield batch, [shingle_set(hashes[begin[i] : begin[i + 1]]) for i in range(batch.num_rows)]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.int64()), ("signature", pa.list_(pa.int64()))])
    for batch, sets in _sets(batches):
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("place"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([signature(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ],
            schema=schema,
        )


def _class_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """class, signature and set of the texts that are of the class they were fetched for."""
    for batch, sets in _sets(batches):
        own = [i for i, (c, s) in enumerate(zip(batch.column("class").to_pylist(), sets)) if len(s) and class_of(s) == c]
        yield pa.RecordBatch.from_arrays(
            [batch.column("class").take(pa.array(own, pa.int64())), pa.array([signature(sets[i]).tobytes() for i in own], pa.binary()), pa.array([sets[i].tobytes() for i in own], pa.binary())],
            names=["class", "signature", "set"],
        )


def similar(inter: np.ndarray | int, a, b) -> np.ndarray | bool:
    return 100 * inter >= SIMILAR_PERCENT * (a + b - inter)


def _array(value, kind) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with signatures and sets, those that collide often enough and then are links."""
    for batch in batches:
        keep = []
        for s, t, x, y in zip(*(batch.column(c) for c in ("signature_a", "signature_b", "set_a", "set_b"))):
            link = int((_array(s, np.int64) == _array(t, np.int64)).sum()) >= MATCHES
            if link:
                x, y = _array(x, np.uint64), _array(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                link = bool(similar(int((both[1:] == both[:-1]).sum()), len(x), len(y)))
            keep.append(link)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) that are links. A leader has many pairs: they come by a join that Spark can split."""
    side = lambda x: sets.select(F.col("class").alias(x), F.col("signature").alias(f"signature_{x}"), F.col("set").alias(f"set_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "signature_a", "signature_b", "set_a", "set_b").mapInArrow(_confirm, "a long, b long")


def _find(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _collisions(block: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
    """Members outside and inside, and which of them collide often enough though their components differ."""
    outside, inside = block[block["outer"]], block[~block["outer"]]
    count = np.zeros((len(outside), len(inside)), np.uint8)
    if count.size:
        s, t = (np.stack([np.frombuffer(x, np.int64) for x in side["signature"]]) for side in (outside, inside))
        for c in range(COORDINATES):
            count += s[:, c, None] == t[None, :, c]
    return outside, inside, (count >= MATCHES) & (outside["component"].to_numpy()[:, None] != inside["component"].to_numpy()[None, :])


def _block_candidates(block: pd.DataFrame) -> pd.DataFrame:
    """The members of two blocks of one neighbourhood that have a candidate in the other."""
    outside, inside, found = _collisions(block)
    some = pd.concat([outside[found.any(axis=1)], inside[found.any(axis=0)]])
    return some[["leader", "class"]].drop_duplicates()


def _block_links(block: pd.DataFrame) -> pd.DataFrame:
    """Links between two blocks of one neighbourhood that join different components; at most one a document."""
    links = []
    outside, inside, found = _collisions(block)
    parent = {c: c for c in [*outside["component"], *inside["component"]]}
    sets = [np.frombuffer(s, np.uint64) for s in inside["set"]]
    sizes = np.array([len(s) for s in sets])
    names, groups = inside["class"].to_numpy(), inside["component"].to_numpy()
    for candidates, name, group, own in zip(found, outside["class"], outside["component"], outside["set"]):
        own = np.frombuffer(own, np.uint64)
        # Sets of too unlike sizes can't be links.
        for j in np.flatnonzero(candidates & similar(np.minimum(len(own), sizes), len(own), sizes)):
            x, y = _find(parent, group), _find(parent, groups[j])
            if x != y:
                places = np.searchsorted(own, sets[j])
                inter = int((own[np.minimum(places, len(own) - 1)] == sets[j]).sum())
                if similar(inter, len(own), len(sets[j])):
                    parent[x] = y
                    links.append((name, names[j]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _with_components(rows: DataFrame, roots: DataFrame) -> DataFrame:
    joined = rows.join(roots.withColumnRenamed("node", "class"), "class", "left")
    return joined.withColumn("component", F.coalesce("root", "class")).drop("root")


def _torn(around: DataFrame) -> DataFrame:
    """leader, top (the largest component), n, n_outside of the neighbourhoods that hold several components."""
    by = around.groupBy("leader", "component").agg(F.count(F.lit(1)).alias("n"))
    per = by.groupBy("leader").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top"))
    return per.filter("n > top.n").select("leader", F.col("top.component").alias("top"), "n", (F.col("n") - F.col("top.n")).alias("n_outside"))


def _in_blocks(around: DataFrame, sets: DataFrame, columns: list[str], size: int) -> DataFrame:
    """Each member outside with each block of all members of its neighbourhood; ``around``: leader, class, component, top, n, n_outside."""
    rows = around.join(sets.select("class", *columns), "class")
    blocks = lambda n: F.ceil(F.col(n) / F.lit(float(size))).cast("int")
    own = F.pmod(F.xxhash64("class"), F.lit(1 << 30))
    spread = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    kept = ["leader", "class", "component", *columns]
    every = rows.select(*kept, F.lit(False).alias("outer"), spread("n_outside").alias("i"), F.pmod(own, blocks("n")).cast("int").alias("j"))
    outer = rows.filter("component <> top").select(*kept, F.lit(True).alias("outer"), F.pmod(own, blocks("n_outside")).cast("int").alias("i"), spread("n").alias("j"))
    return outer.unionByName(every)


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, place (a hash of where the row lies), text of a plain table."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(*place(docs)).alias("place"), "text")


def _postings(classes: DataFrame) -> DataFrame:
    """class, weight, prefix of the classes that may have a link: the postings that they share, without their most frequent MATCHES - 1."""
    posted = classes.select("class", F.explode("signature").alias("key"))
    frequent = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = posted.join(frequent, "key")
    live = shared.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("postings")).filter(F.size("postings") >= MATCHES)
    return live.select(
        "class",
        F.aggregate("postings", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("weight"),
        F.transform(F.slice("postings", 1, F.size("postings") - (MATCHES - 1)), lambda x: x["key"]).alias("prefix"),
    )


def near_links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, root: the smallest class that links reach, of each class that has links to smaller ones.

    ``classes``: class, place, signature; ``docs``: the plain table in which places lie.
    """
    live = spool(_postings(classes), "near-live")
    wanted = live.select("class").join(classes.select("class", "place"), "class")
    if live.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    # One reading of the texts by a place of each class; a set that isn't the class's own is dropped.
    sets = spool(_placed(docs).select("place", "text").join(wanted, "place").mapInArrow(_class_sets, "class long, signature binary, set binary"), "near-sets")

    lists = live.select("class", "weight", F.explode("prefix").alias("key"))
    heads = lists.groupBy("key").agg(F.max(F.struct("weight", "class")).alias("head"))
    around = spool(lists.join(heads, "key").groupBy("class", F.col("head.class").alias("leader")).agg(F.first("head.weight").alias("weight")), "near-around")

    links = spool(_confirmed(around.groupBy(F.col("class").alias("a")).agg(F.max(F.struct("weight", "leader"))["leader"].alias("b")).filter("a <> b"), sets), "near-links")

    def placed() -> DataFrame:
        return spool(_with_components(around.select("leader", "class"), spool(components(links, "a", "b"), "near-roots")), "near-placed")

    def add(found: DataFrame) -> None:
        nonlocal links
        links = links.unionByName(spool(found, "near-links"))

    # All of a document's leaders.
    rows = placed()
    home = rows.filter("class = leader").select("leader", F.col("component").alias("home"))
    add(_confirmed(rows.filter("class <> leader").join(home, "leader").filter("component <> home").select(F.col("class").alias("a"), F.col("leader").alias("b")), sets))

    # Those outside the largest component with a few of its members.
    rows = placed()
    torn = spool(_torn(rows), "near-torn")
    inside = rows.join(torn, "leader").filter("component = top")
    pivots = [F.min(F.struct(F.xxhash64("class", F.lit(i)).alias("h"), F.col("class").alias("b")))["b"] for i in range(PIVOTS)]
    pivots = spool(inside.groupBy("leader").agg(F.array_distinct(F.array(*pivots)).alias("pivots")), "near-pivots")
    outside = rows.join(torn, "leader").filter("component <> top").select("leader", "class").join(pivots, "leader")
    add(_confirmed(outside.select(F.col("class").alias("a"), F.explode("pivots").alias("b")).distinct(), sets))

    # Blocks: collisions first, then the sets of what collides.
    rows = placed()
    rows = spool(rows.join(spool(_torn(rows), "near-torn"), "leader"), "near-torn-rows")
    live_rows = spool(_in_blocks(rows, sets, ["signature"], WIDE_BLOCK).groupBy("leader", "i", "j").applyInPandas(_block_candidates, "leader long, class long").distinct(), "near-active")
    active = rows.join(live_rows, ["leader", "class"])
    sizes = spool(active.groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("component") != F.col("top")).alias("n_outside")), "near-active-sizes")
    active = active.drop("n", "n_outside").join(sizes, "leader")
    add(_in_blocks(active, sets, ["signature", "set"], BLOCK).groupBy("leader", "i", "j").applyInPandas(_block_links, "a long, b long"))
    return components(links, "a", "b")


def _judged(docs: DataFrame) -> DataFrame:
    """doc_id, place, n_shingles, component_id, kept of a plain table's rows; see ``near_dedup``."""
    spark = docs.sparkSession
    with passing(spark) as keep:
        features = _placed(docs).mapInArrow(_features, "doc_id long, place long, n_shingles long, class long, signature array<long>")
        features = keep(spool(features.withColumn("part", F.spark_partition_id()), "near-features"))
        classes = spool(features.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min("place").alias("place"), F.first("signature").alias("signature")), "near-classes")
        roots = spool(near_links(classes.select("class", "place", "signature"), docs), "near-roots")
        named = _with_components(classes.select("class", "doc_id"), roots)
        least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        named = keep(spool(named.select("class", "component").join(least, "component").select("class", "component_id"), "near-named"))
    # A class may hold a third of all rows: its name is looked up once for each task that has met it.
    met = features.filter("class IS NOT NULL").select("part", "class").distinct().join(named, "class")
    rows = features.select("doc_id", "place", "n_shingles", "part", "class").join(met, ["part", "class"], "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "place", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Texts are linked when 100 * intersection >= 75 * union of their sets of 5-word shingles (A-Z as
    a-z; a text of fewer words is one shingle). component_id is the smallest doc_id that links reach.
    Null and empty texts and texts without words have an empty set, no links, and themselves as
    component. Rows with a null doc_id link as texts but name no component unless one with an id is
    reached, and stay. Repeated rows have one component; rows of one id but unlike texts are judged each
    on its own. Long texts count whole; an empty table gives no rows; other columns are ignored.
    """
    return _judged(stored(docs, ["doc_id", "text"], "near-docs")).drop("place")


def unlike_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``near_dedup`` keeps, as they came, whatever their columns are called."""
    docs = stored(docs, docs.columns, "near-docs")
    with passing(docs.sparkSession) as keep:
        goes = keep(spool(_judged(docs).filter("NOT kept").select(F.col("place").alias("_place")), "near-goes"))
    few = F.broadcast(goes) if goes.count() <= BROADCAST_IDS else goes
    rows = docs.select(whole_row(docs).alias("_row"), F.xxhash64(*place(docs)).alias("_place"))
    return rows.join(few, "_place", "left_anti").select("_row.*")


def op9_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir))
