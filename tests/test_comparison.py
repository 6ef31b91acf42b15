"""A made frame of 81 rows whose results are known by hand."""

import math

import pytest
from pyspark.sql import functions as F

from trailstat.functions import scalars as S
from trailstat.operators import catalog, checks, cohort, effects, linkage, resample
from trailstat.plans import comparison, release

TABLES = "/root/testdata/sf0.001"

ACTIONS = [1, 2, 3, 4, 5, 6, 8, 10, 11, 12] * 2
CLASSES = "array<struct<order:int,name:string,class:string,completed:boolean,succeeded:boolean,target_ref:string>>"


def made():
    out = []

    def add(station, s, disposition, actions, verified, modes, stages, words, turn):
        calls = [(i + 1, "x", "modify", True, True, "t.txt") for i in range(actions - verified)] + ([(actions, "x", "verify", True, True, "t.txt")] if verified else [])
        out.append((f"E{len(out):03}", f"S{s}", station, "p", "2026-01-15T12:00:00Z", f"2026-01-15T12:{min(59, actions + 5):02}:00Z", disposition, actions, modes, stages, calls, turn, words))

    for s, station in enumerate(("ST00", "ST04")):
        turn = 0
        if s == 0:
            turn += 1
            add(station, s, "candidate_probable", 1, 0, "bounded_package", "implementation", 3, turn)
        for i, a in enumerate(ACTIONS):
            for is_ce in (1, 0):
                turn += 1
                verified = int((i + s + is_ce) % 3 != 0)
                if is_ce:
                    add(station, s, "candidate_strong", a, verified, "bounded_package", "remediation|audit|audit", 40, turn)
                else:
                    add(station, s, "exclude_no_context_operation", a, verified, "", "implementation", 40, turn)
    return out


@pytest.fixture(scope="module")
def ep(spark):
    df = spark.createDataFrame(made(), f"episode_id string, session_ref string, station_id string, provider string, s string, e string, disposition string, actions int, modes string, stages string, calls {CLASSES}, turn int, words int")
    stages = S.mask(F.col("stages"))
    flag = lambda name: F.array_contains(stages, name).cast("int")
    return df.select(
        "*",
        S.month(F.col("s")).alias("month"),
        F.lit("direct_or_unresolved_user_level").alias("origin"),
        F.lit("no").alias("publication"),
        S.frontloaded(F.lit(0), F.lit(0), S.mask(F.col("modes"))).alias("frontloaded"),
        S.verification_successful(F.col("calls")).alias("verification_successful"),
        flag("audit").alias("audit_signal"),
        flag("remediation").alias("remediation_signal"),
        flag("packaging_release").alias("packaging_release_signal"),
        (F.size(F.array_distinct(stages)) >= 2).cast("int").alias("multistage_signal"),
        (F.col("disposition") == "candidate_strong").cast("int").alias("grounded_decision_trace"),
        S.duration_minutes(F.try_to_timestamp("s"), F.try_to_timestamp("e")).alias("duration_min"),
        F.col("actions").cast("double").alias("completed_substantive_actions"),
    ).withColumn("min_per_action", S.per_action(F.col("duration_min"), F.col("actions"))).cache()


@pytest.fixture(scope="module")
def balanced(ep):
    return cohort.both_sets(cohort.cohorts(ep)).cache()


def test_cohorts_and_balance(ep, balanced):
    rows = cohort.cohorts(ep)
    assert {r["cohort"]: r["count"] for r in rows.groupBy("cohort").count().collect()} == {cohort.CE_LABEL: 40, cohort.COMPARISON_LABEL: 40}
    assert sorted((r["station_id"], r["ce_available"], r["balanced_per_condition"]) for r in cohort.strata(*cohort.arms(rows, False)).collect()) == [("ST00", 20, 20), ("ST04", 20, 20)]
    assert balanced.groupBy("analysis_set", "arm").count().filter("count <> 40").count() == 0
    assert checks.link_invariants(balanced).filter("violations <> 0").count() == 0
    assert checks.strata_agree(balanced, cohort.strata(*cohort.arms(rows, False)), "unrestricted").count() == 0


def test_pooled(balanced):
    got = {r["metric"]: r for r in effects.arm_effects(balanced, ["analysis_set"]).filter("analysis_set = 'primary_frontloaded'").collect()}
    assert (got["verification_successful"]["ce_value"], got["verification_successful"]["effect"]) == (27 / 40, 0)
    assert [got[m]["effect"] for m in ("audit_signal", "remediation_signal", "multistage_signal", "grounded_decision_trace", "packaging_release_signal")] == [1, 1, 1, 1, 0]
    assert (got["duration_min"]["ce_value"], got["completed_substantive_actions"]["ce_value"]) == (10.5, 5.5)
    assert abs(got["min_per_action"]["ce_value"] - 23 / 12) < 1e-12 and got["min_per_action"]["effect"] == 1


def test_equal_station(balanced):
    stations = effects.arm_effects(balanced, ["analysis_set", "station_id"], "median_ratio")
    got = {r["metric"]: r for r in effects.equal_station(stations).filter("analysis_set = 'unrestricted'").collect()}
    v = got["verification_successful"]
    assert abs(v["effect"]) < 1e-15 and (v["positive_stations"], v["tie_stations"], v["negative_stations"], v["descriptive_sign_p"]) == (1, 0, 1, 1.0)
    assert got["audit_signal"]["descriptive_sign_p"] == 0.5
    p = got["packaging_release_signal"]
    assert (p["tie_stations"], p["descriptive_sign_p"]) == (2, None)
    assert effects.equal_station(effects.at_least(stations, 20)).count() == 18 and effects.at_least(stations, 21).count() == 0


def test_bins(balanced):
    bins = effects.action_bins(balanced, ["analysis_set"], (("1-2", 1, 2), ("3-5", 3, 5), ("6-10", 6, 10), ("11+", 11, None)), strict=True)
    got = {r["action_bin"]: (r["ce_k"], r["ce_n"], r["comparison_k"], r["comparison_n"], round(r["comparison_weight"], 12)) for r in bins.filter("analysis_set = 'unrestricted'").collect()}
    assert got == {"1-2": (5, 8, 6, 8, 0.2), "3-5": (8, 12, 8, 12, 0.3), "6-10": (8, 12, 8, 12, 0.3), "11+": (6, 8, 5, 8, 0.2)}
    assert all(abs(r["standardized_gap"]) < 1e-12 and abs(r["raw_gap"]) < 1e-12 for r in effects.standardized_gap(bins, ["analysis_set"]).collect())
    assert checks.bin_checks(bins, ["analysis_set"]).filter("violations <> 0").count() == 0
    later = effects.action_bins(balanced.filter("station_id = 'ST04'"), ["analysis_set"], (("1-2", 1, 2), ("3-5", 3, 5), ("6+", 6, None)))
    gap = effects.standardized_gap(later, ["analysis_set"]).first()
    assert abs(gap["standardized_gap"] + 0.05) < 1e-12 and abs(gap["raw_gap"] + 0.05) < 1e-12


def test_linkage(ep):
    rows = ep.filter("station_id = 'ST00'").select(F.col("episode_id").alias("row_id"), "session_ref", F.col("turn").cast("long").alias("turn"), F.lit(0).alias("line"), "actions", "disposition", "words", F.lit(False).alias("cue"), S.successful_targets(F.col("calls")).alias("targets"), F.array().cast("array<string>").alias("anchors"))
    links = linkage.link(rows, stretch=7)
    assert {r["mapping_class"]: r["count"] for r in links.groupBy("mapping_class").count().collect()} == {"EXACT_SUCCESSFUL_TOOL_TARGET": 20}
    curve = linkage.window_curve(links)
    assert {(r["window"], r["candidate_positive"], r["eligible_rows"]) for r in curve.collect()} == {(w, 20, 20) for w in linkage.WINDOWS}
    assert checks.curve_checks(links, curve).filter("violations <> 0").count() == 0


def test_linkage_cascade(spark):
    ce, cmp_, no = "candidate_probable", "exclude_no_context_operation", "exclude_continuation_only"
    base = [  # turn, actions, disposition, words, cue, targets, anchors
        (1, 1, cmp_, 9, True, ["t"], []), (2, 1, ce, 9, False, ["t"], ["a"]), (3, 1, cmp_, 30, True, [], []), (4, 1, ce, 9, False, [], []), (5, 1, cmp_, 31, True, [], []),
        (6, 1, cmp_, 9, True, ["t", "t"], ["a"]), (7, 1, cmp_, 9, False, [], ["a"]), (8, 1, no, 1, False, [], []), (9, 1, cmp_, 9, True, [], []), (7 + 4, 0, cmp_, 9, True, ["t"], []), (12, 1, cmp_, 9, False, ["u"], []), (30, 1, cmp_, 9, True, [], []), (6, 1, cmp_, 9, False, [], []),
    ]
    rows = spark.createDataFrame([(i, "s", t, i, a, d, w, c, x, y) for i, (t, a, d, w, c, x, y) in enumerate(base)], "row_id long, session_ref string, turn long, line long, actions int, disposition string, words int, cue boolean, targets array<string>, anchors array<string>")
    for stretch in (1, 4, 1000):
        got = {r["row_id"]: (r["mapping_class"], r["matched_prior_ce"], r["minimum_link_window"]) for r in linkage.link(rows, stretch).collect()}
        assert got == {
            0: ("CLEAN_ORIGIN_CANDIDATE", None, None), 2: ("IMMEDIATE_SHORT_REFERENCE", 1, 0), 4: ("IMMEDIATE_ADJACENCY", 3, 1), 5: ("EXACT_SUCCESSFUL_TOOL_TARGET", 1, 0),
            6: ("EXACT_PROMPT_ANCHOR", 1, 0), 8: ("CONTEXT_REFERENCE_WITHIN_20", 3, 5), 10: ("UNRESOLVED_PRIOR_CE_SESSION", 3, None), 11: ("UNRESOLVED_PRIOR_CE_SESSION", 3, 26), 12: ("NEAR_SEQUENCE", 3, 2),
        }


def test_anchors_and_cues(spark):
    text = "Fix ABC-12 in /srv/data/x.py, see Notes.md and /tmp) abc-1"
    row = spark.range(1).select(linkage.prompt_anchors(F.lit(text)).alias("a"), linkage.continuation_cue(F.lit("please KEEP going")).alias("c"), linkage.continuation_cue(F.lit("iteration")).alias("d")).first()
    assert sorted(row["a"]) == ["file:notes.md", "path:/srv/data/x.py", "ticket:ABC-12"] and row["c"] and not row["d"]


def test_sign_test(spark):
    rows = spark.createDataFrame([(9, 1), (8, 2), (0, 0), (5, 5), (30, 12)], "p long, n long").select(S.sign_test(F.col("p"), F.col("n")).alias("s")).collect()
    want = [0.021484375, 0.109375, None, 1.0, min(1, 2 * sum(math.comb(42, i) for i in range(13)) / 2**42)]
    assert all(a["s"] is b if b is None else abs(a["s"] - b) < 1e-12 for a, b in zip(rows, want))


def test_bootstrap(spark):
    values = [0.1, 0.25, -0.05, 0.4, 0.0]
    low, high = resample.seeded_interval(values, "u:m", 500, 7)
    assert -0.05 <= low < sum(values) / 5 < high <= 0.4 and resample.seeded_interval(values, "u:m", 500, 7) == (low, high)
    assert resample.linear_quantile([1.0, 2.0, 4.0], 0.75) == 3.0
    rows = spark.createDataFrame([("u", f"S{i}", "m", "risk_difference", v) for i, v in enumerate(values)] + [("u", "S1", "r", "median_ratio", 2.0), ("u", "S2", "r", "median_ratio", 0.5)], "analysis_set string, station_id string, metric string, effect_scale string, effect double")
    got = {r["metric"]: r for r in resample.exact_bootstrap(rows, 500, 7).collect()}
    assert (got["m"]["ci_low"], got["m"]["ci_high"]) == (low, high) and abs(got["r"]["effect"] - 1) < 1e-12
    native = {r["metric"]: r for r in resample.native_bootstrap(rows, 500).collect()}
    assert abs(native["m"]["ci_low"] - low) < 0.05 and native["r"]["ci_low"] >= 0.5


def test_intervals_of_equal_station_tables(spark, monkeypatch):
    monkeypatch.setattr(resample.with_intervals, "__defaults__", (300, resample.SEED))
    stations = comparison._stations(spark, TABLES).collect()
    want = {}
    for least, suffix in ((0, ""), (20, "_min20")):
        for name, metric in {(r["analysis_set"], r["metric"]) for r in stations}:
            used = [r for r in sorted(stations, key=lambda r: r["station_id"]) if (r["analysis_set"], r["metric"]) == (name, metric) and r["rows_per_condition"] >= least and r["effect"] is not None]
            ratio = metric in effects.RATIO
            values = [math.log(r["effect"]) if ratio else r["effect"] for r in used if not ratio or r["effect"] > 0]
            if values:
                ends = resample.seeded_interval(values, f"{name}{suffix}:{metric}", 300)
                want[name + suffix, metric] = [math.exp(v) if ratio else v for v in ends]
    got = {(r["analysis_set"], r["metric"]): [r["ci_low"], r["ci_high"]] for r in comparison.equal_station_intervals(spark, TABLES).collect()}
    assert got.keys() == want.keys() and all(abs(x - y) < 1e-12 for k in got for x, y in zip(got[k], want[k]))
    plain = {tuple(r) for r in release.catalog_views(spark, TABLES).collect()}
    whole = release.catalog_with_intervals(spark, TABLES)
    assert {tuple(r) for r in whole.drop("ci_low", "ci_high").collect()} == plain
    ends = {r["source_record"]: (r["ci_low"], r["ci_high"]) for r in whole.filter("view IN ('equal_station', 'minimum_station_size')").collect()}
    assert ends == {"/".join(k): tuple(round(x, 9) for x in v) for k, v in want.items()}
    assert whole.filter("view NOT IN ('equal_station', 'minimum_station_size') AND ci_low IS NOT NULL").count() == 0


def test_the_registered_bootstrap_draws_as_often_as_the_reference(monkeypatch):
    monkeypatch.setattr(comparison, "_stations", lambda *_: None)
    monkeypatch.setattr(resample, "exact_bootstrap", lambda rows, repetitions=resample.REPETITIONS: repetitions)
    assert comparison.bootstrap_ci_exact(None, "") == 50_000


def test_scalars(spark):
    row = spark.range(1).select(
        S.whole(F.lit("1.0")).alias("a"), S.whole(F.lit(" 7 ")).alias("b"), S.whole(F.lit("x"), 3).alias("c"), S.canonical_mask(F.lit("b||a|b")).alias("d"), S.month(F.lit("2026-01-31T23:30:00-05:00")).alias("e"),
        S.session_of(F.lit("SRC-SRC-1")).alias("f"), S.duration_minutes(F.lit("2026-01-02 00:00:00").cast("timestamp"), F.lit("2026-01-01 00:00:00").cast("timestamp")).alias("g"), S.exact_count(F.lit(0.25), F.lit(8)).alias("h"),
        S.first_given(F.lit(None).cast("string"), F.lit(""), F.lit("z")).alias("i"), S.effect(F.lit(1.0), F.lit(0.0), F.lit("median_ratio")).alias("j"), S.is_yes(F.lit("YES")).alias("k"),
    ).first()
    assert tuple(row) == (0, 7, 3, "a|b", "2026-01", "SS-SRC-1", 0.0, 2, "z", None, 1)
    with pytest.raises(Exception, match="unknown scale"):
        spark.range(1).select(S.effect(F.lit(1.0), F.lit(2.0), F.lit("odds"))).collect()
    with pytest.raises(Exception, match="no count"):
        spark.range(1).select(S.exact_count(F.lit(0.3), F.lit(8))).collect()


def test_catalog_and_dictionary(spark, balanced):
    pooled = effects.arm_effects(balanced, ["analysis_set"])
    bins = effects.action_bins(balanced, ["analysis_set"], (("all", 0, None),))
    rows = catalog.catalog({"pooled": pooled, "action_count_bin": bins})
    assert rows.count() == 20 == rows.select("record_id").distinct().count() and {"gap", "effect"} <= set(rows.columns)
    table = spark.createDataFrame([("1", "1.5", "yes", "x", None), ("", "2", "no", "3", None)], "i string, n string, b string, s string, e string")
    got = {r["field"]: (r["data_type"], r["nullable"]) for r in catalog.dictionary(table, "t").collect()}
    assert got == {"i": ("integer", True), "n": ("number", False), "b": ("boolean", False), "s": ("string", False), "e": ("empty", True)}


def test_same_values(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 3.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0 + 1e-14), ("y", 2.1), ("w", 1.0), ("z", 3.0), ("z", 3.0)], "k string, v double")
    assert {r["k"] for r in checks.same_values(a, b, ["k"], ["v"]).collect()} == {"y", "z", "w"}
