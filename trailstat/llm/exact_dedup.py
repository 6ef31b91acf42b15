"""Exact deduplication as a stateful stream.

A stream reads digests and keeps, per digest, the smallest identifier seen, its content locator
(file and row) and the number of rows, in a disk-backed (RocksDB) keyed state that never expires.
Every hit is then checked on its full bytes against the text at the kept locator; digests that hold
different texts are resolved by the texts themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RUN, documents, new_path, passing, place, relation_paths, spool, stored, whole_row

STORE = "spark.sql.streaming.stateStore."
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Places of dropped rows up to this many are sent to all executors (some 100 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Rows of one digest that are compared with one copy of its kept text.
SALTED = 256


def normalised(text: Column) -> Column:
    """Null as empty; each run of the six spaces as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _with_rocksdb(spark: SparkSession) -> SparkSession:
    """A session of its own with the disk-backed state store, without files allocated ahead (a state may have very many partitions)."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set(STORE + "providerClass", ROCKSDB)
    own.conf.set(STORE + "rocksdb.allowFAllocate", "false")
    return own


def update_state(digests: DataFrame, state_path: str, files_per_trigger: int = 10_000) -> None:
    """Stream the rows of ``digests`` (a spooled table) that are new since the last call into the state at ``state_path``.

    Each micro-batch is pre-aggregated per task before it is dealt out by digest, so a digest that a
    third of all rows share costs its reducer one row per task.
    """
    (path,) = relation_paths(digests)
    stream = _with_rocksdb(digests.sparkSession).readStream.schema(digests.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("file"), F.col("row"))
    kept = stream.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
    kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", state_path).trigger(availableNow=True).start().awaitTermination()


def read_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The state as a table: digest, first (no_id, doc_id, file, row), n."""
    state = _with_rocksdb(spark).read.format("statestore").option("path", state_path).load()
    value = state.schema["value"].dataType.names
    return state.select(F.col("key.digest").alias("digest"), F.col(f"value.`{value[0]}`").alias("first"), F.col(f"value.`{value[1]}`").alias("n"))


def exact_dedup(docs: DataFrame, digest=sha256, files_per_trigger: int = 10_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of space and U+0009 to U+000D becomes one space; a
    null text is empty. Of equal texts the row with the smallest doc_id stays (a null id counts as
    largest; of repeated rows with that id, the first by file and row). An empty table gives no rows;
    very long texts are read whole; other columns are ignored. ``digest`` may be any function of the
    normalised text: full bytes decide.
    """
    docs = stored(docs, ["doc_id", "text"], "dedup-docs")
    with passing(docs.sparkSession) as keep:
        return _decided(docs, digest, files_per_trigger, keep).drop("file", "row")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, as they came, whatever their columns are called."""
    docs = stored(docs, docs.columns, "dedup-docs")
    with passing(docs.sparkSession) as keep:
        goes = keep(spool(_decided(docs, sha256, 10_000, lambda table: table).filter("NOT kept").select(F.col("file").alias("_file"), F.col("row").alias("_at")), "dedup-goes"))
    few = F.broadcast(goes) if goes.count() <= BROADCAST_ROWS else goes
    file, row = place(docs)
    rows = docs.select(whole_row(docs).alias("_row"), file.alias("_file"), row.alias("_at"))
    return rows.join(few, ["_file", "_at"], "left_anti").select("_row.*")


def _decided(docs: DataFrame, digest, files_per_trigger: int, keep) -> DataFrame:
    """With file and row; the tables that the result reads are given to ``keep``."""
    spark = docs.sparkSession
    at = [c.alias(name) for c, name in zip(place(docs), ("file", "row"))]
    text = normalised(F.col("text"))
    normal = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *at, text.alias("t"))
    digests = keep(spool(normal.select("doc_id", "file", "row", digest(F.col("t")).alias("digest"), sha256(F.col("t")).alias("text_sha256")), "dedup-digests"))
    state_path = new_path(spark, "dedup-state")
    update_state(digests, state_path, files_per_trigger)
    groups = new_path(spark, "dedup-groups")
    read_state(spark, state_path).write.parquet(groups)
    groups = keep(spark.read.parquet(groups))

    placed = digests.join(groups, "digest")
    stays = F.col("file").eqNullSafe(F.col("first.file")) & F.col("row").eqNullSafe(F.col("first.row"))
    result = placed.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").cast("long").alias("group_size"), stays.alias("kept"), "text_sha256", "file", "row", "digest")

    # Full bytes of every hit against the text at the kept locator.
    # A digest may be that of a third of all rows: its hits go to one place for each SALTED rows, with a copy of the kept text.
    parts = F.ceil(F.col("n") / F.lit(float(SALTED))).cast("long")
    copies = placed.filter("n > 1").select("doc_id", "file", "row", "digest", "text_sha256", stays.alias("stays"), parts.alias("parts"))
    texts = docs.select(*at, text.alias("t"))
    copies = spool(texts.join(copies, ["file", "row"]), "dedup-copies")
    kept = copies.filter("stays").select("digest", F.col("t").alias("kept_t"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    hits = copies.filter("NOT stays").select("digest", "t", F.pmod(F.xxhash64("file", "row"), F.col("parts")).alias("part"))
    unequal = spool(hits.join(kept, ["digest", "part"]).filter(~F.col("t").eqNullSafe(F.col("kept_t"))).select("digest"), "dedup-unequal")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "file", "row"]
    if unequal.isEmpty():
        return result.select(*columns)

    keep(copies)
    unequal = keep(unequal).distinct()
    mixed = copies.drop("parts").join(unequal, "digest", "left_semi")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("file"), F.col("row"))
    exact = mixed.groupBy("text_sha256", "t").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
    resolved = mixed.select("doc_id", "file", "row", "text_sha256", "t").join(exact, ["text_sha256", "t"])
    resolved = resolved.select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").cast("long").alias("group_size"), stays.alias("kept"), "text_sha256", "file", "row")
    return result.join(unequal, "digest", "left_anti").select(*columns).unionByName(resolved)


def op2_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


ORACLE = {
    "op2_stream_dedup": """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM t WINDOW g AS (PARTITION BY t)""",
}
