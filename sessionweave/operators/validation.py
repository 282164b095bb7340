"""Validation of session documents before anything is built from them: four lists of messages a session, a verdict, and reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import version
from ..sources.sessions import LEAST_VERSION, REQUIRED

KINDS = ("structural", "behavioural", "consistency", "warnings")


def _messages(rules: list[tuple[Column, Column | str]]) -> Column:
    said = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(m) if isinstance(m, str) else m) for c, m in rules))
    return F.filter(said, lambda x: x.isNotNull())


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("nothing"))


def check_sessions(folders: DataFrame, docs: DataFrame, keys: DataFrame, meta: DataFrame, schema_name: str, least_events: int = 500, require_meta: bool = True) -> DataFrame:
    """One row per folder: participantId, figures, a list of messages of each kind, and status FAIL, WARN or PASS.

    folders, docs, keys and meta are what sources.sessions reads.  Structural messages concern the export, behavioural ones whether the
    session is complete, consistency the manifest against the document; the last two only warn.  An event whose kind or time is null
    counts as one that lacks it."""
    d = docs.withColumnsRenamed({"sessionId": "sid", "_corrupt": "broken"})
    m = meta.select(F.col("folder"), F.lit(True).alias("has_meta"), F.col("sessionId").alias("m_sid"), F.col("eventCount").alias("m_events"), F.col("usableForSignalExtraction").alias("m_usable"), F.col("uploadStatus").alias("m_status"), F.col("_corrupt").alias("m_broken"))
    x = folders.join(d, "folder", "left").join(keys, "folder", "left").join(m, "folder", "left")
    parsed = F.col("has_session") & F.col("broken").isNull() & F.col("keys").isNotNull()
    n = F.greatest(F.coalesce(F.size("events"), F.lit(0)), F.lit(0))
    x = x.withColumns({"parsed": F.coalesce(parsed, F.lit(False)), "n_events": n})
    bad = F.filter(F.transform(F.coalesce("events", F.array().cast(docs.schema["events"].dataType)), lambda e, i: F.when(e.isNull() | e["kind"].isNull() | e["tRelMs"].isNull(), i)), lambda i: i.isNotNull())
    lacking = F.array_sort(F.array_except(F.array(*(F.lit(k) for k in REQUIRED)), F.col("keys")))
    x = x.withColumns({"bad": bad, "lacking": lacking, "has_meta": F.coalesce("has_meta", F.lit(False))})
    ok, q, has = F.col("parsed"), F.col("qualitySummary"), F.col("has_meta") & F.col("m_broken").isNull()
    least = F.array(*(F.lit(v) for v in LEAST_VERSION))
    usable, done, wanted, completed = q["usableForSignalExtraction"], F.col("completedNormally"), q["expectedTaskCount"], q["completedTaskCount"]
    structural = [
        (~F.col("has_session"), "no session.json"),
        (F.col("has_session") & ~ok, "session.json is no JSON object"),
        (ok & (F.size("lacking") > 0), F.concat(F.lit("keys missing: "), F.array_join("lacking", ", "))),
        (ok & ~F.col("schemaName").eqNullSafe(F.lit(schema_name)), F.concat(F.lit("schema name is "), _text(F.col("schemaName")))),
        (ok & (F.col("schemaVersion").isNull() | (version(F.col("schemaVersion")) < least)), F.concat(F.lit(f"schema version below {'.'.join(map(str, LEAST_VERSION))}: "), _text(F.col("schemaVersion")))),
        (ok & ~F.col("sid").eqNullSafe(F.col("folder")), "session id differs from folder"),
        (ok & (F.coalesce("participantId", F.lit("")) == ""), "no participant id"),
        (ok & (F.col("n_events") == 0), "no events"),
        (ok & (F.size("bad") > 0), F.concat(F.size("bad").cast("string"), F.lit(" events without kind or time, at "), F.array_join(F.slice("bad", 1, 5).cast("array<string>"), ", "))),
        (ok & ~F.col("has_meta") & F.lit(require_meta), "no manifest: the upload is not confirmed"),
        (ok & F.col("has_meta") & F.col("m_broken").isNotNull(), "manifest is no JSON"),
        (ok & has & ~F.col("m_sid").eqNullSafe(F.col("folder")), "manifest's session id differs from folder"),
    ]
    behavioural = [
        (ok & ~F.coalesce(done, F.lit(False)), F.concat(F.lit("not completed normally: "), _text(done))),
        (ok & ~F.coalesce(usable, F.lit(False)), F.concat(F.lit("not usable for signal extraction: "), _text(usable))),
        (ok & (F.size(q["missingTaskIds"]) > 0), F.concat(F.lit("tasks missing: "), F.array_join(q["missingTaskIds"], ", "))),
        (ok & (completed < wanted), F.concat(completed.cast("string"), F.lit(" tasks of "), wanted.cast("string"))),
        (ok & (F.col("n_events") < least_events), F.concat(F.lit("few events: "), F.col("n_events").cast("string"), F.lit(f" < {least_events}"))),
    ]
    consistency = [
        (ok & has & (F.col("m_events") != F.col("n_events")), F.concat(F.lit("manifest counts "), F.col("m_events").cast("string"), F.lit(" events, the document "), F.col("n_events").cast("string"))),
        (ok & has & (F.col("m_usable") != usable), "manifest and document disagree on usability"),
        (ok & has & (F.col("m_status") != "success"), F.concat(F.lit("upload status is "), F.col("m_status"))),
    ]
    warnings = [
        (ok & ~F.col("has_meta") & F.lit(not require_meta), "no manifest: the upload is not confirmed"),
        (ok & (F.size(q["warnings"]) > 0), F.concat(F.lit("quality warnings: "), F.array_join(q["warnings"], ", "))),
    ]
    x = x.withColumns(dict(zip(KINDS, map(_messages, (structural, behavioural, consistency, warnings)), strict=True)))
    figures = [F.col("n_events").cast("long").alias("events"), F.greatest(F.coalesce(F.size("taskSummary"), F.lit(0)), F.lit(0)).cast("long").alias("tasks"), wanted.alias("expected_tasks"), done.alias("completed_normally"), usable.alias("usable"), F.col("device.deviceFamily").alias("device_family"), F.col("context.devicePlatform").alias("device_platform"), "appVersion", "schemaVersion", "identitySource", q["hasMotion"].alias("has_motion"), q["hasOrientation"].alias("has_orientation"), F.col("sessionDurationMs").alias("duration_ms")]
    status = F.when((F.size("structural") > 0) | (F.size("behavioural") > 0), "FAIL").when((F.size("consistency") > 0) | (F.size("warnings") > 0), "WARN").otherwise("PASS")
    return x.select("folder", F.when(ok, F.nullif(F.col("participantId"), F.lit(""))).alias("participantId"), *figures, *KINDS, status.alias("status"))


def roll_up(checked: DataFrame, least_sessions: int = 1, least_participants: int = 1) -> DataFrame:
    """One row: sessions and participants, how many pass, warn and fail, and the verdict over all."""
    of = lambda s: F.count(F.when(F.col("status") == s, 1))
    out = checked.agg(F.count(F.lit(1)).alias("sessions"), F.count_distinct("participantId").alias("participants"), of("PASS").alias("passed"), of("WARN").alias("warned"), of("FAIL").alias("failed"))
    bad = (F.col("failed") > 0) | (F.col("sessions") < least_sessions) | (F.col("participants") < least_participants)
    return out.withColumn("verdict", F.when(bad, "FAIL").when(F.col("warned") > 0, "WARN").otherwise("PASS"))


def write_text(spark, path: str, lines) -> None:
    """A text file at a path of any file system that Spark knows, line by line."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        for line in lines:
            out.write(bytearray((line + "\n").encode()))
    finally:
        out.close()


def write_reports(checked: DataFrame, folder: str, least_sessions: int = 1, least_participants: int = 1) -> str:
    """validation.json and validation.md below folder; sessions come one by one.  Returns the verdict."""
    spark = checked.sparkSession
    total = roll_up(checked, least_sessions, least_participants).first().asDict()
    each = checked.orderBy("folder")

    def as_json():
        yield "{"
        yield f'"total": {json.dumps(total)}, "sessions": {{'
        for i, r in enumerate(each.toLocalIterator()):
            yield ("," if i else "") + f"{json.dumps(r['folder'])}: {json.dumps(r.asDict())}"
        yield "}}"

    def as_markdown():
        yield "# Session validation"
        yield ""
        yield from (f"- {k}: {v}" for k, v in total.items())
        yield from ("", "## Sessions", "")
        for r in each.toLocalIterator():
            yield f"- `{r['folder']}`: {r['status']} ({r['events']} events, {r['tasks']} of {r['expected_tasks']} tasks)"
            yield from (f"  - {kind}: {m}" for kind in KINDS for m in r[kind])

    write_text(spark, f"{folder}/validation.json", as_json())
    write_text(spark, f"{folder}/validation.md", as_markdown())
    return total["verdict"]
