"""Session documents and streams."""

import json

from pyspark.sql import functions as F

from sessionweave.sources import sessions as src


NAME = "some_app"


def document(sid, **more):
    ev = [{"kind": "task_start", "tRelMs": 0, "payload": {"taskType": "typing"}}, {"kind": "keydown", "tRelMs": 5.5, "payload": {"keyClass": "LETTER", "nested": {"a": [1, 2]}}}, None, {"kind": "keyup"}]
    return {"schemaName": NAME, "schemaVersion": "1.2.0", "sessionId": sid, "participantId": "p", "device": {"deviceFamily": "mobile"}, "context": {"fatigue": "3", "focusLevel": ""}, "startedAtIso": "2024-01-01T00:00:00Z", "events": ev} | more


def test_documents(spark, tmp_path):
    docs = {"a": document("a"), "b": document("b", schemaVersion="1.1.9"), "c": document("x"), "d": document("d", events=[]), "e": document("e", schemaName="other", schemaVersion="x"), "f": "{broken"}
    for name, d in docs.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "session.json").write_text(d if isinstance(d, str) else json.dumps(d))
    read = src.read_documents(spark, str(tmp_path)).cache()
    m = {r["folder"]: r for r in src.manifest(read, NAME).collect()}
    assert m["a"]["included"] and m["a"]["eventCount"] == 4
    assert {k: m[k]["issues"] for k in "bcdef"} == {"b": "schemaVersion too old", "c": "sessionId differs from folder", "d": "no events", "e": "unexpected schemaName; schemaVersion too old", "f": "invalid JSON"}
    raw = src.flatten(read, NAME)
    rows = raw.orderBy("eventIndex").collect()
    assert [r["eventIndex"] for r in rows] == [0, 1, 3] and rows[1]["payload_nested"] == '{"a": [1, 2]}' and rows[0]["rowId"] == "a__0"
    assert {"usableForSignalExtraction", "devicePlatform", "consentVersion"} <= set(raw.columns) and "ctxDevicePlatform" not in raw.columns
    assert rows[0]["ctxFatigue"] == 3 and rows[0]["ctxFocusLevel"] is None
    p = {r["column"]: r for r in src.profile(raw).collect()}
    assert p["payload_keyClass"]["nonNull"] == 1 and p["kind"]["pct"] == 100.0
    src.write_events(raw, str(tmp_path / "raw"))
    got, missing = src.read_columns(spark, str(tmp_path / "raw"), ["sessionId", "kind", "nothing"])
    assert got.count() == 3 and missing == ["nothing"]
    over = spark.createDataFrame([("a", "desktop")], "sessionId string, participantId string")
    assert {r["participantId"] for r in src.with_overrides(read.where("folder = 'a'"), over).collect()} == {"desktop"}
    new, stale = src.new_and_stale(spark.createDataFrame([("a",), ("b",)], "sessionId string"), spark.createDataFrame([("b",), ("z",)], "sessionId string"))
    assert [r[0] for r in new.collect()] == ["a"] and [r[0] for r in stale.collect()] == ["z"]


def test_streams(spark, tmp_path):
    from sessionweave.streaming import windows

    rows = spark.range(40).select((F.col("id") % 2).alias("key"), F.timestamp_seconds(F.col("id") * 5).alias("ts"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    for name, make in (("sliding", windows.sliding_counts), ("runs", lambda s, k, t: windows.sessions(s, k, t, gap="1 minute"))):
        stream = make(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "key", "ts")
        q = stream.writeStream.format("memory").queryName(name).outputMode("complete" if name == "sliding" else "append").option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert spark.table("sliding").agg(F.sum("n")).first()[0] == 80  # two windows for each event
