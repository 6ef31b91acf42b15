import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from trailstat.operators import boundary, manifest
from trailstat.sources import readers, writers


def test_json_lines_from_folders_and_zips(spark, tmp_path):
    lines = ['{"a": 1}', "", "né"]
    body = "\n".join(lines) + "\n"
    (tmp_path / "d/sub").mkdir(parents=True)
    (tmp_path / "d/sub/s1.jsonl").write_text(body)
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("x/restricted/interaction_sources/s1.jsonl", body)
        z.writestr("x/other/s2.jsonl", body)
    digest = hashlib.sha256(body.encode()).hexdigest()
    want = [("s1", i, x, digest) for i, x in enumerate(lines, 1)]
    assert sorted(map(tuple, readers.json_lines(spark, str(tmp_path / "d")).collect())) == want
    assert sorted(map(tuple, readers.zipped_lines(spark, str(tmp_path / "p.zip")).collect())) == want
    specs = lambda h: readers.source_specs(spark.createDataFrame([("s1", "p", h, "C2"), ("s1", "p", h, "C1"), ("s1", "p", h, "")], "source_ref string, provider string, sha256 string, case_id string"))
    spec = specs(digest).first()
    assert spec["case_ids"] == ["C1", "C2"] and spec["source_ref"] == "SRC-" + hashlib.sha256(b"s1").hexdigest()[:20]
    assert readers.verified(readers.json_lines(spark, str(tmp_path / "d")), specs(digest)).count() == 3
    with pytest.raises(Exception, match="hash mismatch"):
        readers.verified(readers.json_lines(spark, str(tmp_path / "d")), specs("0" * 64)).collect()
    with pytest.raises(Exception, match="two providers"):
        readers.source_specs(spark.createDataFrame([("s", "p", "", ""), ("s", "q", "", "")], "source_ref string, provider string, sha256 string, case_id string")).collect()


def test_json_lines_of_files_in_many_splits(spark, tmp_path):
    bodies = {"a b+c%20": "".join(f"line {i} é\r\n" for i in range(3000)), "open": "x\n\n\ny" * 700, "blank": "\n\n", "lone": "z", "only": "\n", "empty": ""}
    (tmp_path / "d").mkdir()
    with zipfile.ZipFile(tmp_path / "p.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in bodies.items():
            (tmp_path / f"d/{name}.jsonl").write_bytes(body.encode())
            z.writestr(f"restricted/interaction_sources/{name}.jsonl", body.encode())
    want = []
    for name, body in bodies.items():
        lines = body.removesuffix("\n").split("\n") if body else []
        want += [(name, i, x, hashlib.sha256(body.encode()).hexdigest()) for i, x in enumerate(lines, 1)]
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "4096")
        files = readers.json_lines(spark, str(tmp_path / "d"))
        assert sorted(map(tuple, files.collect())) == sorted(want)
    finally:
        spark.conf.set(key, before)
    assert sorted(map(tuple, readers.zipped_lines(spark, str(tmp_path / "p.zip"), chunk=7, rows=100).collect())) == sorted(want)


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('a "quoted"\nline', None, 3), ("b,c", "", 4)], "x string, y string, n int")
    writers.csv(df, str(tmp_path / "o"), ["x", "n", "missing"])
    got = readers.csv(spark, str(tmp_path / "o"))
    assert got.columns == ["x", "n", "missing"] and sorted((r["x"], r["n"], r["missing"] or "") for r in got.collect()) == [('a "quoted"\nline', "3", ""), ("b,c", "4", "")]
    writers.split(df, str(tmp_path / "s"), ["n"])
    assert readers.csv(spark, str(tmp_path / "s/public")).columns == ["n"]


def test_summary_and_its_cells(spark, tmp_path):
    writers.summary(str(tmp_path / "s.json"), {"rows": spark.createDataFrame([(1, 2.5)], "a int, b double")}, {"scope": {"n": 3, "m": "x"}})
    text = (tmp_path / "s.json").read_text()
    assert json.loads(text)["rows"] == [{"a": 1, "b": 2.5}]
    cells = readers.summary_cells(spark.createDataFrame([("s", text)], "label string, text string"), "$.scope").collect()
    assert {(r["key"], r["value"]) for r in cells} == {("n", "3"), ("m", "x")}
    with pytest.raises(ValueError):
        writers.summary(str(tmp_path / "t.json"), {"rows": spark.range(5)}, {}, most_rows=4)


def test_contract():
    assert readers.contract('{"cutoff_id": "c"}', '{"cutoff_id": "c"}')[0] == {"cutoff_id": "c"}
    with pytest.raises(ValueError):
        readers.contract('{"cutoff_id": "c"}', '{"cutoff_id": "d"}')


def test_manifest_over_a_tree(spark, tmp_path):
    root = tmp_path / "r"
    (root / "a").mkdir(parents=True)
    (root / "tmp").mkdir()
    (root / "a/x.txt").write_text("1")
    (root / "y.txt").write_text("2")
    (root / "tmp/z.txt").write_text("3")
    entries = manifest.manifest(readers.tree(spark, str(root)))
    lines = manifest.manifest_lines(entries)
    assert [r["value"] for r in lines.collect()] == [f"{hashlib.sha256(b'1').hexdigest()}  a/x.txt", f"{hashlib.sha256(b'2').hexdigest()}  y.txt"]
    writers.lines(lines.coalesce(1), str(tmp_path / "m"))
    back = manifest.parse_lines(spark.read.text(str(tmp_path / "m")))
    assert manifest.difference(back, entries).count() == 0
    (root / "y.txt").write_text("changed")
    (root / "new.txt").write_text("4")
    (root / "a/x.txt").unlink()
    now = manifest.manifest(readers.tree(spark, str(root)))
    assert {(r["path"], r["status"]) for r in manifest.difference(back, now).collect()} == {("a/x.txt", "missing"), ("new.txt", "unlisted"), ("y.txt", "changed")}


def test_differing_rows(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert sorted((r["x"], r["side"]) for r in manifest.differing_rows(a, b).collect()) == [(1, "before"), (3, "after")]


def test_boundary(spark):
    texts = [("p", "see /home/me/x"), ("e", "write to a.b@c.org now"), ("k", "AKIA" + "A" * 16), ("g", "ghp_" + "a" * 24), ("i", "EP-1234abcd"), ("c", "clean text"), ("w", r"C:\Users\me\x"), ("f", "column prompt_text")]
    df = spark.createDataFrame(texts, "label string, text string")
    got = {(r["label"], r["finding"]) for r in boundary.text_findings(df, field_names=True).collect()}
    assert got == {("p", "absolute path"), ("e", "email"), ("k", "AWS access key"), ("g", "GitHub token"), ("i", "row identifier"), ("w", "absolute path (drive)"), ("f", "row-level field prompt_text")}
    paths = spark.createDataFrame([("data/raw/x.csv",), ("raw.csv",), ("a/balanced_strata.csv",), ("ok/x.md",), ("Raw/x.csv",), ("a/PROMPTS",), ("a/b.local.csv",), ("a/b.exe",), ("LICENSE",), (".gitignore",), ("w.xlsx",)], "path string")
    assert {(r["path"], r["finding"]) for r in boundary.path_findings(paths).collect()} == {
        ("data/raw/x.csv", "forbidden folder"), ("a/balanced_strata.csv", "forbidden file"), ("Raw/x.csv", "forbidden folder"), ("a/PROMPTS", "forbidden folder"),
        ("a/PROMPTS", "unapproved file type"), ("a/b.local.csv", "forbidden file"), ("a/b.exe", "unapproved file type"),
    }
    heads = spark.createDataFrame([("t", ["episode_id", "metric"]), ("u", ["metric"])], "label string, columns array<string>")
    assert [(r["label"], r["finding"]) for r in boundary.header_findings(heads).collect()] == [("t", "episode_id")]
    nested = spark.createDataFrame([("j", '{"a": [{"b": {"session_ref": 1}}]}'), ("n", "no json"), ("z", None)], "label string, text string")
    assert [(r["label"], r["finding"]) for r in boundary.json_findings(nested).collect()] == [("j", "session_ref")]


def test_workbook_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sheet.xml", "<c>a@b.org</c>")
        z.writestr("xl/vbaProject.bin", b"\x00")
    rows = readers.workbook_texts(spark, str(tmp_path / "w.xlsx"))
    assert {r["label"] for r in rows.collect()} == {"w.xlsx!xl/sheet.xml", "w.xlsx!xl/vbaProject.bin"}
    assert {r["finding"] for r in boundary.text_findings(rows).collect()} == {"email"}
    assert rows.filter(F.col("label").contains("vbaProject")).count() == 1
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "l.xlsx", "w") as z:
        z.writestr("xl/externalLinks/externalLink1.xml", "<x/>")
    found = boundary.workbook_findings(readers.workbook_texts(spark, str(tmp_path)), readers.archives(spark, str(tmp_path)))
    assert {(r["label"], r["finding"]) for r in found.collect()} == {("w.xlsx", "workbook macro"), ("w.xlsx!xl/sheet.xml", "email"), ("l.xlsx", "external workbook link"), ("bad.xlsx", "invalid xlsx container")}
