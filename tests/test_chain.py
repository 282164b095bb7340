"""The batch chain: validation of documents, quality gates, the screening ladder, modality tables and verification on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionweave.operators import quality, screening, validation
from sessionweave.plans import run
from sessionweave.sources import sessions, sinks

NAME = "some_app"


def document(sid, **more):
    events = [{"kind": "keydown", "tRelMs": float(i)} for i in range(6)]
    return {"schemaName": NAME, "schemaVersion": "1.3.0", "appVersion": "1", "sessionId": sid, "participantId": "p" + sid, "identitySource": "x", "sessionIndex": 1, "startedAtIso": "2024-01-01T00:00:00Z", "completedAtIso": "2024-01-01T00:01:00Z", "completedNormally": True, "events": events, "taskSummary": [{"taskId": "a"}], "qualitySummary": {"usableForSignalExtraction": True, "expectedTaskCount": 1, "completedTaskCount": 1, "missingTaskIds": [], "warnings": []}} | more


def put(folder, name, content):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content))


@pytest.fixture(scope="module")
def documents(tmp_path_factory):
    root = tmp_path_factory.mktemp("sessions")
    good = document("good")
    short = {k: v for k, v in document("short").items() if k != "appVersion"} | {"participantId": ""}
    bad_events = document("bad")
    bad_events["events"] = [None, {"kind": "x"}, *bad_events["events"]]
    poor = document("poor", completedNormally=False)
    poor["qualitySummary"] = {"usableForSignalExtraction": False, "expectedTaskCount": 3, "completedTaskCount": 2, "missingTaskIds": ["t9"], "warnings": ["motion"]}
    for d in (good, short, bad_events, poor, document("other"), document("plain")):
        put(root / d["sessionId"], "session.json", d)
        if d["sessionId"] != "plain":
            put(root / d["sessionId"], "meta.json", {"sessionId": d["sessionId"], "eventCount": len(d["events"]), "uploadStatus": "success", "usableForSignalExtraction": True})
    put(root / "other", "meta.json", {"sessionId": "other", "eventCount": 99, "uploadStatus": "started"})
    put(root / "broken", "session.json", "{no")
    put(root / "empty", "meta.json", {"sessionId": "empty"})
    return str(root)


def test_validation(spark, documents, tmp_path):
    read = [f(spark, documents) for f in (sessions.folders, sessions.read_documents, sessions.read_keys, sessions.read_meta)]
    checked = validation.check_sessions(*read, NAME, least_events=5).cache()
    got = {r["folder"]: r for r in checked.collect()}
    assert {k: r["status"] for k, r in got.items()} == {"good": "PASS", "short": "FAIL", "bad": "FAIL", "poor": "FAIL", "other": "WARN", "plain": "FAIL", "broken": "FAIL", "empty": "FAIL"}
    assert got["short"]["structural"] == ["keys missing: appVersion", "no participant id"] and got["short"]["participantId"] is None
    assert got["bad"]["structural"] == ["2 events without kind or time, at 0, 1"]
    assert [m.split(":")[0] for m in got["poor"]["behavioural"]] == ["not completed normally", "not usable for signal extraction", "tasks missing", "2 tasks of 3"]
    assert got["poor"]["warnings"] == ["quality warnings: motion"] and got["poor"]["consistency"] == ["manifest and document disagree on usability"]
    assert got["other"]["consistency"] == ["manifest counts 99 events, the document 6", "upload status is started"]
    assert got["plain"]["structural"] == ["no manifest: the upload is not confirmed"]
    assert got["broken"]["structural"] == ["session.json is no JSON object"] and got["empty"]["structural"] == ["no session.json"]
    free = validation.check_sessions(*read, NAME, least_events=7, require_meta=False).where("folder in ('plain', 'good')")
    assert {r["folder"]: (r["status"], len(r["warnings"])) for r in free.collect()} == {"plain": ("FAIL", 1), "good": ("FAIL", 0)}
    assert validation.roll_up(checked.where("folder in ('good', 'other')")).first()["verdict"] == "WARN"
    assert validation.roll_up(checked.where("folder = 'good'"), 2).first()["verdict"] == "FAIL"
    assert validation.write_reports(checked, str(tmp_path)) == "FAIL"
    told = json.loads((tmp_path / "validation.json").read_text())
    assert told["total"]["sessions"] == 8 and told["sessions"]["good"]["status"] == "PASS"
    assert "- `good`: PASS (6 events, 1 of 1 tasks)" in (tmp_path / "validation.md").read_text()


def test_sinks(spark, documents, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 2.0)], "id int, name string, v double")
    where = str(tmp_path / "t")
    assert {r["column"]: r["nonNull"] for r in sinks.write_with_profile(df, where, {"x": 1}).collect()} == {"id": 2, "name": 2, "v": 1}
    side = json.loads((tmp_path / "t_profile.json").read_text())
    assert side["rows"] == 2 and side["parameters"] == {"x": 1} and side["fields"]["v"]["pct"] == 50.0
    assert sinks.first_existing(spark, [where + "_not", where]) == where
    with pytest.raises(FileNotFoundError):
        sinks.first_existing(spark, [where + "_not"])
    assert sinks.read_csv_columns(spark, where + "_csv", lambda c: c != "v").columns == ["id", "name"]
    sinks.write_results(df.select("name", "id", F.lit(1).alias("k")), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).columns == ["k", "name", "id"]
    both, missing = sinks.assemble(spark, {"a": str(tmp_path / "r"), "b": where + "_not", "c": where + "_csv"})
    assert both.count() == 4 and missing == ["b"] and {r["source"] for r in both.collect()} == {"a", "c"}
    assert sinks.publish(df, str(tmp_path / "up"), dry_run=True) == {"documents": 2, "manifest": 0} and not (tmp_path / "up").exists()
    sinks.publish(df, str(tmp_path / "up"), df)
    with pytest.raises(FileExistsError):
        sinks.publish(df, str(tmp_path / "up"))
    assert {r["sessionId"] for r in sinks.listed_sessions(spark, documents, 1).collect()} == {"good", "short", "bad", "poor", "other", "plain", "broken", "empty"}
    got = sinks.pending(spark.createDataFrame([("a",), ("b",)], "sessionId string"), spark.createDataFrame([("b",), ("c",)], "sessionId string"))
    assert {tuple(r) for r in got.collect()} == {("a", "fetch"), ("b", "skip"), ("c", "stale")}
    (tmp_path / "key").write_text("k")
    assert sinks.check_credentials("KEY", {"KEY": str(tmp_path / "key")}) == str(tmp_path / "key")
    for env in ({}, {"KEY": str(tmp_path / "none")}):
        with pytest.raises(RuntimeError):
            sinks.check_credentials("KEY", env)


def test_gates(spark):
    df = spark.createDataFrame([(1, True), (2, False)], "n int, x_afforded boolean").withColumn("x_straddle_conflict", F.lit(None).cast("boolean"))
    got = {r["check"]: r["status"] for r in quality.run_checks(df, {"good": lambda w: quality.core_missing(w, {"n": "x", "gone": "x"}), "bad": lambda w: w.select("nothing")}).collect()}
    assert got == {"core_missing_n": "PASS", "core_missing_gone": "WARN", "bad_raised": "FAIL"}


def test_ladder(spark):
    rows = [  # feature, partner, corr, n, is_empty, is_near_empty, exposure_flag, locked
        ("tap_force_mean", "m_a", 1.0, 90, False, False, False, True),
        ("m_empty", None, None, 0, True, False, False, None),
        ("m_few", None, None, 1, False, True, True, None),
        ("x_count", "m_b", 1.0, 90, False, False, True, None),
        ("m_exposed", "m_c", 0.5, 90, False, False, True, None),
        ("m_a", "tap_force_mean", 1.0, 90, False, False, False, False),
        ("m_b", "x_count", 1.0, 90, False, False, False, None),
        ("m_c", "m_d", 1.0, 90, False, False, False, None),
        ("m_d", "m_c", 1.0, 95, False, False, False, True),
        ("m_e", "m_f", 1.0, 90, False, False, None, None),
        ("m_f", "m_e", 1.0, 90, False, False, None, None),
        ("m_g", "m_f", 1.0, 90, False, False, None, None),
    ]
    diag = spark.createDataFrame(rows, "feature string, partner string, corr double, n long, is_empty boolean, is_near_empty boolean, exposure_flag boolean, locked boolean")
    got = {r["feature"]: r["decision_reason"] for r in screening.decide(diag).collect()}
    assert got == {
        "tap_force_mean": "hard_excluded_family", "m_empty": "fully_empty", "m_few": "near_empty", "x_count": "count_like", "m_exposed": "high_exposure_corr",
        "m_a": "duplicate_of_dropped:tap_force_mean:hard_excluded_family", "m_b": "duplicate_of_dropped:x_count:count_like", "m_c": "duplicate_of:m_d",
        "m_d": "device_locked_needs_manual_review", "m_e": "kept", "m_f": "duplicate_of:m_e", "m_g": "kept",
    }
    issue = {r[0]: r[1] for r in spark.createDataFrame([("tap_radiusX_n",), ("tap_coverage",), ("m",)], "f string").select("f", screening.known_issue(F.col("f"))).collect()}
    assert issue["tap_radiusX_n"] == "follows the device model" and issue["tap_coverage"] and issue["m"] is None
    with pytest.raises(ValueError, match="SessionId"):
        screening.check_leaks(["a", "SessionId"])


def test_pairs_and_components(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 4)) @ rng.standard_normal((4, 4)) + 1e6
    x[rng.random((300, 4)) < 0.2] = np.nan
    x = np.column_stack([x, np.full(300, 7.0), [np.nan] * 280 + [1.0, 2.0] * 10])
    names = list("abcdef")
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in x], ", ".join(f"{c} double" for c in names)).repartition(5)
    got = {(r["a"], r["b"]): (r["overlap"], r["r"]) for r in screening.pairwise_correlation(df, names).collect()}
    for i in range(6):
        for j in range(i + 1, 6):
            ok = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
            n, r = got.get((names[i], names[j]), (0, None))
            assert n == ok.sum()
            if n >= 30 and j < 4:
                assert abs(r - np.corrcoef(x[ok, i], x[ok, j])[0, 1]) < 1e-9
            else:
                assert r is None
    full = np.where(np.isfinite(x[:, :5]), x[:, :5], np.nanmedian(x[:, :5], axis=0))
    z = (full - full.mean(axis=0)) / np.where(full.std(axis=0) > 0, full.std(axis=0), 1)
    want = np.sort(np.linalg.svd(z, compute_uv=False) ** 2)[::-1]
    pc, shares = screening.principal_components(df, names[:5])
    assert np.allclose(shares, want[:2] / want.sum(), atol=1e-6)
    assert np.allclose(np.var([r["pc"] for r in pc.collect()], axis=0), want[:2] / 300, atol=1e-4)


def test_chain_from_windows(spark, tmp_path):
    """From a written table of windows on: gates, diagnostics, decisions, modality tables, splits and verification."""
    rng = np.random.default_rng(5)
    rows, raw = [], []
    for p in range(5):
        for s in range(3):
            raw.append((f"p{p}", f"s{p}{s}", s))
            for w in range(24):
                v = p * 3 + rng.standard_normal()
                rows.append((f"s{p}{s}", w, f"p{p}", "mobile", f"d{p % 2}", w * 7.5, w * 7.5 + 15, True, True, True, True, True, False, False, False, float(v), float(2 * v), float(rng.standard_normal()), 0.5, float(w % 7), float(v + 1), 0.25 + p + 0.1 * float(rng.standard_normal()), None))
    cols = "sessionId string, window_index int, participantId string, deviceFamily string, deviceModel string, window_start_s double, window_end_s double, typing_afforded boolean, tapping_afforded boolean, typing_observed boolean, tapping_observed boolean, scrolling_observed boolean, typing_straddle_conflict boolean, tapping_straddle_conflict boolean, scrolling_straddle_conflict boolean, typing_dwell_ms_mean double, typing_dwell_ms_median double, typing_dwell_ms_std double, tap_force_mean double, tap_count double, tap_x_mean double, motion_idle_frac double, gesture_hold_ms_mean double"
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "windows"))
    spark.createDataFrame(raw, "participantId string, sessionId string, sessionIndex int").write.parquet(str(tmp_path / "raw"))
    c = run.Chain(spark, "", str(tmp_path), NAME, ks=(1, 3), seeds=(0,))
    c.qc()
    status = {r["check"]: r["status"] for r in c.read("qc").collect()}
    assert status["core_missing_typing_dwell_ms_n"] == "WARN" and status["sessions_3"] == "INFO" and status["sample_size"] == "WARN"
    c.diagnostics()
    diag = {r["feature"]: r for r in c.read("diagnostics").collect()}
    assert diag["tap_force_mean"]["needs_review"] and diag["gesture_hold_ms_mean"]["is_empty"] and diag["typing_dwell_ms_mean"]["governing_flag"] == "typing_afforded"
    c.behavioural()
    why = {r["feature"]: r["decision_reason"] for r in c.read("decisions").collect()}
    assert why["tap_force_mean"] == "hard_excluded_family" and why["tap_count"] == "count_like" and why["gesture_hold_ms_mean"] == "fully_empty"
    assert sum(why[f].startswith("duplicate_of:") for f in ("typing_dwell_ms_mean", "typing_dwell_ms_median", "tap_x_mean")) == 1
    table = c.read("behavioural")
    assert "tap_force_mean" not in table.columns and {"sessionId", "deviceModel", "motion_idle_frac"} <= set(table.columns)
    with pytest.raises(ValueError, match="gesture"):
        c.modality()
    for m in ("typing", "tap", "motion"):
        try:
            c.write(screening.modality_table(table, m), f"modality_{m}")
        except ValueError:
            assert m == "tap"  # its one feature may be the duplicate that went
    c.splits()
    assert {(r["role"], r["n"]) for r in c.read("splits").groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()} == {("train", 5), ("enrol", 5), ("probe", 5)}
    results, each = run.verify(c.read("modality_motion"), c.read("splits"), (1, 3), lambda df, name: c.write(df, f"parts/{name}"), (0,))
    got = {(r["k"], r["identity_set"]): r for r in results.collect()}
    assert got[1, "all_available"]["auc"] > 0.95 and got[3, "fixed_across_k"]["n_probe_identities"] == 5 and got[1, "all_available"]["fitted_on"] == "train_only"
    assert {n for _, n in got} == {"all_available", "fixed_across_k", "control_0"}
    assert each.count() == 10
