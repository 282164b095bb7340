"""Sinks with sidecars, tolerant scans and the checks around them."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sessions import profile


def _path(spark: SparkSession, where: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(where)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, where: str) -> bool:
    p, fs = _path(spark, where)
    return fs.exists(p)


def first_existing(spark: SparkSession, candidates: list[str]) -> str:
    """The first candidate path that is there."""
    for c in candidates:
        if exists(spark, c):
            return c
    raise FileNotFoundError(f"none of {candidates}")


def check_credentials(variable: str, environment: Mapping[str, str] = os.environ) -> str:
    """The file that an environment variable names; raises if the variable is unset or the file isn't there."""
    where = environment.get(variable, "")
    if not where:
        raise RuntimeError(f"{variable} is not set")
    if not os.path.isfile(where):
        raise RuntimeError(f"{variable} names {where}, which is no file")
    return where


def listed_sessions(spark: SparkSession, path: str, depth: int = 3) -> DataFrame:
    """sessionId and path of every file below path, the id being the segment that is depth from the end of paths such as
    kind/user/session/file counted without the file; paths with too few segments are left out.  Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    root, fs = _path(spark, path)
    base = fs.makeQualified(root).toString().rstrip("/") + "/"
    own = F.split(F.replace(F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/"), F.lit(base.replace("///", "/")), F.lit("")), "/")
    return files.select(F.get(own, F.lit(depth - 1)).alias("sessionId"), "path").where(F.size(own) > depth)


def pending(remote: DataFrame, local: DataFrame, key: str = "sessionId") -> DataFrame:
    """What a sync would do with each id: fetch, skip (it is here) or stale (it is here only)."""
    a, b = remote.select(key).distinct().withColumn("r", F.lit(True)), local.select(key).distinct().withColumn("l", F.lit(True))
    return a.join(b, key, "full").select(key, F.when(F.col("l").isNull(), "fetch").when(F.col("r").isNull(), "stale").otherwise("skip").alias("action"))


def publish(docs: DataFrame, out: str, manifest: DataFrame | None = None, dry_run: bool = False) -> dict[str, int]:
    """Writes documents, and their manifest after them, to a place where nothing may be yet; a dry run only counts."""
    spark = docs.sparkSession
    if exists(spark, out):
        raise FileExistsError(out)
    counts = {"documents": docs.count(), "manifest": manifest.count() if manifest is not None else 0}
    if not dry_run:
        docs.write.mode("errorifexists").json(f"{out}/documents")
        if manifest is not None:
            manifest.write.mode("errorifexists").json(f"{out}/manifest")
    return counts


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV with a header; columns in order come first, as far as they are there, then the others."""
    first = [c for c in order or [] if c in df.columns]
    df.select(*first, *[c for c in df.columns if c not in first]).write.mode("overwrite").option("header", True).csv(path)


def read_csv_columns(spark: SparkSession, path: str, wanted) -> DataFrame:
    """The columns of a CSV with a header whose names wanted(name) accepts, others unread."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if wanted(c)])


def write_with_profile(df: DataFrame, path: str, parameters: dict | None = None, csv: bool = True) -> DataFrame:
    """Parquet at path, CSV beside it unless left out, and a JSON profile of the columns as written; returns the profile."""
    from ..operators.validation import write_text

    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    if csv:
        write_csv(back, f"{path}_csv")
    out = profile(back)
    head = {"rows": back.count(), "columns": len(back.columns), "parameters": parameters or {}}
    cols = {r["column"]: {"type": r["type"], "non_null": r["nonNull"], "pct": r["pct"]} for r in out.collect()}  # one a column
    write_text(spark, f"{path}_profile.json", [json.dumps(head | {"fields": cols})])
    return out


#: Columns of verification results, in the order in which they are written if they are there.
RESULT_ORDER = ["modality", "k", "identity_set", "median_span_s", "n_comparisons", "n_trust_windows", "n_probe_identities", "n_reference_identities", "n_features", "fitted_on", "auc", "eer", "far", "auc_norm", "eer_norm", "far_norm", "auc_loo_min", "auc_loo_max", "skipped"]


def write_results(results: DataFrame, path: str) -> None:
    write_csv(results, path, RESULT_ORDER)


def assemble(spark: SparkSession, sources: dict[str, str]) -> tuple[DataFrame | None, list[str]]:
    """Union of the CSVs of results that are there, with the name of each as source, and the names of those that are missing."""
    out, missing = None, []
    for name, path in sources.items():
        if not exists(spark, path):
            missing.append(name)
            continue
        one = spark.read.option("header", True).csv(path).withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out, missing
