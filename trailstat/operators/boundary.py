"""Disclosure scan: what must not be in published text, headers and paths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import nested_keys

# Patterns, field names, folders and files that a public release must not hold.
PATTERNS = {
    "absolute path": r"/(?:Users|home)/[^/\s]+/",
    "absolute path (drive)": r"[A-Za-z]:\\Users\\[^\\\s]+\\",
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "GitHub token": r"\b(?:gh[pousr]|github_pat)_[A-Za-z0-9_]{20,}\b",
    "AWS access key": r"\bAKIA[0-9A-Z]{16}\b",
    "private key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "row identifier": r"\b(?:EP|LINK|SESSION|MAP)-[A-Za-z0-9]{8,}\b",
}
ROW_LEVEL_FIELDS = (
    "episode_id", "prompt_text", "prompt_excerpt", "session_ref", "source_ref", "timestamp_start_utc", "timestamp_end_utc",
    "tool_trace_json", "target_ref", "sample_link_id", "mapping_id", "prior_ce_episode_id",
)
TEXT_SUFFIXES = (".cff", ".csv", ".json", ".md", ".py", ".sha256", ".txt", ".yml", ".yaml")
TEXT_FILES = (".gitattributes", ".gitignore", "LICENSE")
WORKBOOK_SUFFIX, LOCAL_SUFFIX = ".xlsx", ".local.csv"
#: Where fields of rows may be named: documentation and programs.
NAMING_SUFFIXES = (".md", ".py")
FORBIDDEN_FOLDERS = ("raw", "restricted", "interim", "prompts")
FORBIDDEN_FILES = ("balanced_strata.csv", "primary_balanced_rows.csv", "unrestricted_balanced_rows.csv", "inheritance_candidate_map.csv", "extended_multistation_context_episode_review.local.csv")


def text_findings(texts: DataFrame, field_names: bool = False) -> DataFrame:
    """label, finding for every pattern that a text (label, text) holds; with ``field_names``, row-level field names too."""
    found = [F.when(F.col("text").rlike(p), F.lit(name)) for name, p in PATTERNS.items()]
    if field_names:
        found += [F.when(F.col("text").contains(f), F.lit(f"row-level field {f}")) for f in ROW_LEVEL_FIELDS]
    return texts.select("label", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("finding"))


def _name(path: str = "path"):
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: str = "path"):
    """The last ending of a path's file name, in lower case; none where the only dot is its first character."""
    return F.lower(F.regexp_extract(_name(path), r"(?<=.)\.[^.]+$", 0))


def path_findings(paths: DataFrame) -> DataFrame:
    """path, finding for relative paths with a forbidden part (in any case, file names included), a forbidden name, or a type that isn't let out."""
    forbidden = F.exists(F.split(F.lower("path"), "/"), lambda p: p.isin(*FORBIDDEN_FOLDERS))
    rows = F.col("_name").isin(*FORBIDDEN_FILES) | F.col("_name").endswith(LOCAL_SUFFIX)
    type_ = ~F.col("_suffix").isin(*TEXT_SUFFIXES, WORKBOOK_SUFFIX) & ~F.col("_name").isin(*TEXT_FILES)
    found = F.array(F.when(forbidden, "forbidden folder"), F.when(rows, "forbidden file"), F.when(type_, "unapproved file type"))
    rows = paths.withColumns({"_name": _name(), "_suffix": suffix()})
    return rows.select("path", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("finding"))


def file_findings(files: DataFrame) -> DataFrame:
    """path, finding of files (path, text): paths, patterns, row-level fields in texts, CSV headers and JSON keys, JSON that isn't any.

    Workbooks are read by their members (``workbook_findings``).
    """
    texts = files.withColumns({"_suffix": suffix(), "_name": _name()}).filter(F.col("_suffix").isin(*TEXT_SUFFIXES) | F.col("_name").isin(*TEXT_FILES))
    labelled = texts.select(F.col("path").alias("label"), "text", "_suffix")
    may_name = F.col("_suffix").isin(*NAMING_SUFFIXES)
    plain = text_findings(labelled)
    named = labelled.filter(~may_name & F.col("text").rlike("|".join(ROW_LEVEL_FIELDS))).select("label", F.lit("possible row-level field name").alias("finding"))
    csv = labelled.filter("_suffix = '.csv'").select("label", F.transform(F.split(F.regexp_extract("text", "^[^\r\n]*", 0), ","), lambda x: F.regexp_replace(x, '^"|"$', "")).alias("columns"))
    leaked = F.array_intersect(F.array_sort("columns"), F.array(*[F.lit(f) for f in ROW_LEVEL_FIELDS]))
    csv = csv.withColumn("_leaked", leaked).filter(F.size("_leaked") > 0).select("label", F.concat(F.lit("row-level columns "), F.array_join("_leaked", ", ")).alias("finding"))
    json = labelled.filter("_suffix = '.json'")
    invalid = json.filter(F.try_parse_json("text").isNull()).select("label", F.lit("invalid JSON").alias("finding"))
    keys = json_findings(json).groupBy("label").agg(F.concat(F.lit("row-level JSON keys "), F.array_join(F.array_sort(F.collect_set("finding")), ", ")).alias("finding"))
    found = plain.unionByName(named).unionByName(csv).unionByName(invalid).unionByName(keys)
    return path_findings(files).unionByName(found.select(F.col("label").alias("path"), "finding")).distinct()


def workbook_findings(members: DataFrame, archives: DataFrame) -> DataFrame:
    """label, finding of workbooks: links to others, macros, what their texts hold, and archives that are none.

    ``members``: archive, member, label, text; ``archives``: archive, is_zip.
    """
    link = members.filter(F.col("member").startswith("xl/externalLinks/")).select(F.col("archive").alias("label"), F.lit("external workbook link").alias("finding"))
    macro = members.filter(F.col("member").endswith("vbaProject.bin")).select(F.col("archive").alias("label"), F.lit("workbook macro").alias("finding"))
    bad = archives.filter("NOT is_zip").select(F.col("archive").alias("label"), F.lit("invalid xlsx container").alias("finding"))
    return link.unionByName(macro).unionByName(bad).unionByName(text_findings(members, field_names=True)).distinct()


def header_findings(headers: DataFrame) -> DataFrame:
    """label, finding for columns (label, columns) that are row-level fields."""
    return headers.select("label", F.explode(F.array_intersect("columns", F.array(*[F.lit(f) for f in ROW_LEVEL_FIELDS]))).alias("finding"))


def json_findings(texts: DataFrame) -> DataFrame:
    """label, finding for JSON keys at any depth that are row-level fields. A walk of unknown depth, so an Arrow function."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(label, key) for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()) if text for key in dict.fromkeys(nested_keys(text)) if key in ROW_LEVEL_FIELDS]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["label", "finding"])

    return texts.select("label", "text").mapInArrow(walk, "label string, finding string")
