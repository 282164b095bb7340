"""Session documents: scan, structural gate, flattening to canonical raw events, manifests, profiles and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_int, version

# fixed values: the document's least version and fields.  Its schema name is a parameter
LEAST_VERSION = (1, 2, 0)
REQUIRED = ("schemaName", "schemaVersion", "appVersion", "sessionId", "participantId", "identitySource", "sessionIndex", "startedAtIso", "completedAtIso", "completedNormally", "events", "taskSummary", "qualitySummary")
COMMON = ("kind", "tRelMs", "timestampIso", "taskId", "taskIndex", "screenId", "componentId", "activeArea", "instructionArea")
TOP = ("sessionId", "participantId", "identitySource", "schemaName", "schemaVersion", "appVersion", "sessionIndex", "startedAtIso", "completedAtIso", "completedNormally", "sessionDurationMs")
CONTEXT = ("timeOfDay", "inputDevice", "movement", "environmentNoise", "privacy", "alcohol", "caffeine", "posture", "handUse")
DOCUMENT = """schemaName string, schemaVersion string, appVersion string, sessionId string, participantId string, identitySource string, sessionIndex int, startedAtIso string,
 completedAtIso string, completedNormally boolean, sessionDurationMs double, device struct<deviceFamily: string>,
 context struct<devicePlatform: string, deviceModel: string, consentVersion: string, fatigue: string, focusLevel: string, timeOfDay: string, inputDevice: string, movement: string, environmentNoise: string, privacy: string, alcohol: string, caffeine: string, posture: string, handUse: string>,
 taskSummary array<map<string, string>>, qualitySummary struct<usableForSignalExtraction: boolean, expectedTaskCount: int, completedTaskCount: int, missingTaskIds: array<string>, warnings: array<string>, hasMotion: boolean, hasOrientation: boolean>,
 events array<struct<kind: string, tRelMs: double, timestampIso: string, taskId: string, taskIndex: int, screenId: string, componentId: string, activeArea: string, instructionArea: string, payload: map<string, string>>>, _corrupt string"""


def folder_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """folder and keys, the top-level keys of each session.json; null if it is no JSON object."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "session.json").text(path)
    return text.select(folder_of(F.input_file_name()).alias("folder"), F.json_object_keys("value").alias("keys"))


def folders(spark: SparkSession, path: str) -> DataFrame:
    """Every folder below path that holds a file, and whether session.json is one of them; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.groupBy(folder_of(F.col("path")).alias("folder")).agg(F.bool_or(F.col("path").endswith("/session.json")).alias("has_session"))


def read_meta(spark: SparkSession, path: str, name: str = "meta.json") -> DataFrame:
    """One row per manifest document below path/<session>/, written when an upload had ended."""
    schema = "sessionId string, eventCount long, usableForSignalExtraction boolean, uploadStatus string, _corrupt string"
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", name).schema(schema).json(path)
    return raw.withColumn("folder", folder_of(F.input_file_name()))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per session.json below path/<session>/, with folder; nested payload values stay JSON text."""
    raw = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", "session.json").schema(DOCUMENT).json(path)
    return raw.withColumn("folder", folder_of(F.input_file_name()))


def structural_issues(docs: DataFrame, schema_name: str) -> Column:
    """Reasons to leave a document out, joined by "; "; empty if there is none."""
    least = F.array(*(F.lit(x) for x in LEAST_VERSION))
    rules = {
        "invalid JSON": F.col("_corrupt").isNotNull(),
        "unexpected schemaName": F.col("_corrupt").isNull() & ~F.col("schemaName").eqNullSafe(F.lit(schema_name)),
        "schemaVersion too old": F.col("_corrupt").isNull() & (version(F.col("schemaVersion")) < least),
        "sessionId differs from folder": F.col("_corrupt").isNull() & ~F.col("sessionId").eqNullSafe(F.col("folder")),
        "no events": F.col("_corrupt").isNull() & (F.coalesce(F.size("events"), F.lit(0)) <= 0),
    }
    return F.concat_ws("; ", *(F.when(c, F.lit(m)) for m, c in rules.items()))


def manifest(docs: DataFrame, schema_name: str) -> DataFrame:
    issues = structural_issues(docs, schema_name)
    return docs.select("folder", "sessionId", "participantId", F.greatest(F.coalesce(F.size("events"), F.lit(0)), F.lit(0)).alias("eventCount"), (issues == "").alias("included"), issues.alias("issues"))


def with_overrides(docs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Columns of overrides(sessionId, ...) replace those of docs where they are not null."""
    names = [c for c in overrides.columns if c != "sessionId"]
    o = overrides.select("sessionId", *(F.col(c).alias(f"__{c}") for c in names))
    return docs.join(o, "sessionId", "left").withColumns({c: F.coalesce(f"__{c}", c) if c in docs.columns else F.col(f"__{c}") for c in names}).drop(*(f"__{c}" for c in names))


def flatten(docs: DataFrame, schema_name: str, payload: list[str] | None = None) -> DataFrame:
    """Canonical raw events: session fields, event fields and one payload_<key> column per key.

    An event that is null or no object is skipped without renumbering the others.  Without a list of keys they are looked
    up first, which reads the documents twice."""
    ok = docs.where(structural_issues(docs, schema_name) == "")
    ctx = [F.col(f"context.{c}").alias("ctx" + c[0].upper() + c[1:]) for c in CONTEXT] + [safe_int(F.col(f"context.{c}")).alias("ctx" + c[0].upper() + c[1:]) for c in ("fatigue", "focusLevel")]
    e = ok.select(*TOP, F.col("device.deviceFamily").alias("deviceFamily"), *(F.col(f"context.{c}").alias(c) for c in ("devicePlatform", "deviceModel", "consentVersion")), F.col("qualitySummary.usableForSignalExtraction").alias("usableForSignalExtraction"), *ctx, F.posexplode("events").alias("eventIndex", "e"))
    empty = F.coalesce(*(F.col(f"e.{c}").cast("string") for c in COMMON)).isNull() & F.col("e.payload").isNull()
    e = e.where(F.col("e").isNotNull() & ~empty)
    if payload is None:
        payload = sorted(r[0] for r in e.select(F.explode(F.map_keys("e.payload"))).distinct().collect())  # keys of the schema's tail
    return e.select(F.concat_ws("__", "sessionId", "eventIndex").alias("rowId"), *[c for c in e.columns if c != "e"], *(F.col(f"e.{c}").alias(c) for c in COMMON), *(F.col("e.payload")[k].alias(f"payload_{k}") for k in payload))


def profile(df: DataFrame) -> DataFrame:
    """Type, non-null count and percentage of every column, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("__rows"), *(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns))
    kinds = F.create_map(*(x for f in df.schema for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))))
    long = one.unpivot(["__rows"], [F.col(f"`{c}`") for c in df.columns], "column", "nonNull")
    return long.select("column", kinds[F.col("column")].alias("type"), "nonNull", F.round(F.col("nonNull") * 100.0 / F.when(F.col("__rows") > 0, F.col("__rows")), 2).alias("pct"))


def write_events(raw: DataFrame, path: str) -> None:
    """Parquet clustered by session and sorted by event, so that row-group statistics prune; fails if path exists."""
    raw.repartition("sessionId").sortWithinPartitions("sessionId", "eventIndex").write.mode("errorifexists").parquet(path)


def read_columns(spark: SparkSession, path: str, wanted: list[str]) -> tuple[DataFrame, list[str]]:
    """The wanted columns that a Parquet path has, and the names it lacks."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in wanted if c in df.columns]), [c for c in wanted if c not in df.columns]


def new_and_stale(remote: DataFrame, local: DataFrame, key: str = "sessionId") -> tuple[DataFrame, DataFrame]:
    """Ids to ingest, and ids that are here but no longer there (reported, never deleted)."""
    return remote.select(key).join(local.select(key), key, "left_anti"), local.select(key).join(remote.select(key), key, "left_anti")


def session_index(raw: DataFrame) -> DataFrame:
    """Sessions in order of their start per participant, with the hours since the one before."""
    s = raw.groupBy("sessionId", "participantId").agg(F.min(F.try_to_timestamp("startedAtIso")).alias("started"), F.max("tRelMs").alias("lastMs"))
    w = Window.partitionBy("participantId").orderBy("started", "sessionId")
    gap = (F.unix_micros("started") - F.unix_micros(F.lag("started").over(w))) / 3.6e9
    return s.withColumns({"sessionNo": F.row_number().over(w), "gapHours": gap})
