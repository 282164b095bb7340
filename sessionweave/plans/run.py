"""Batch chain from session documents to verification results: each stage reads and writes tables below one folder.

    python -m sessionweave.plans.run SESSIONS OUT --schema NAME [--from STAGE] [--skip-csv]

Stages halt for different reasons.  validate reports and never stops the chain, as a poor session is a matter for later screens; raw stops
it if no session passes the structural gate; qc stops it on a hard failure, not on warnings; any other stage by raising.  Decisions are a
table of their own beside the diagnostics they come from, as a table can't be read and overwritten at once."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import explore, features, quality, scoring, screening, validation, verification
from ..sources import sessions, sinks

STAGES = ("validate", "raw", "windows", "qc", "diagnostics", "behavioural", "modality", "splits", "trust")
CORE = {"typing_dwell_ms_n": "typing", "tap_count": "tapping", "gesture_n_interactions": "tapping"}
FLAGS = [f"{m}_observed" for m in features.MODALITY_KINDS]


class Halt(RuntimeError):
    """The chain can't go on."""


class Chain:
    def __init__(self, spark: SparkSession, source: str, out: str, schema_name: str, csv: bool = True, ks: tuple[int, ...] = verification.KS, seeds: tuple[int, ...] = (0, 1, 2), family: str = "mobile"):
        self.spark, self.source, self.out, self.schema_name, self.csv, self.ks, self.seeds, self.family = spark, source, out.rstrip("/"), schema_name, csv, ks, seeds, family

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/{name}")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.out}/{name}")
        return self.read(name)

    def run(self, start: str = STAGES[0]) -> None:
        for name in STAGES[STAGES.index(start) :]:
            getattr(self, name)()

    def validate(self) -> None:
        s, p = self.spark, self.source
        checked = validation.check_sessions(sessions.folders(s, p), sessions.read_documents(s, p), sessions.read_keys(s, p), sessions.read_meta(s, p), self.schema_name)
        validation.write_reports(self.write(checked, "validation"), f"{self.out}/reports")

    def raw(self) -> None:
        docs = sessions.read_documents(self.spark, self.source)
        listed = self.write(sessions.manifest(docs, self.schema_name), "manifest")
        if self.csv:
            sinks.write_csv(listed, f"{self.out}/manifest_csv")
        if not listed.where("included").take(1):
            raise Halt("no session passes the structural gate")
        flat = sessions.flatten(docs, self.schema_name).repartition("sessionId").sortWithinPartitions("sessionId", "eventIndex")
        sinks.write_with_profile(flat, f"{self.out}/raw", csv=self.csv)

    def windows(self) -> None:
        raw = self.read("raw")
        sinks.write_with_profile(features.build_windows(raw), f"{self.out}/windows", {"length_s": features.LENGTH_S, "stride_s": features.STRIDE_S}, self.csv)

    def qc(self) -> None:
        checks = {
            "report": lambda w: quality.report(w, features.KEY, FLAGS, 1000, 10, "participantId"),
            "core": lambda w: quality.core_missing(w, CORE),
            "sessions": lambda w: quality.session_distribution(w, "participantId", "sessionId"),
        }
        if self.write(quality.run_checks(self.read("windows"), checks), "qc").where("status = 'FAIL'").take(1):
            raise Halt("a quality gate failed")

    def _features(self, table: DataFrame) -> list[str]:
        return [c for c in features.feature_names() if c in table.columns]

    def diagnostics(self) -> None:
        w = self.read("windows")
        self.write(screening.diagnose(w, self._features(w), features.KEY), "diagnostics")

    def behavioural(self) -> None:
        decided = self.write(screening.decide(self.read("diagnostics")), "decisions")
        table, report = screening.candidate(self.read("windows"), decided)
        self.write(table, "behavioural")
        validation.write_text(self.spark, f"{self.out}/reports/columns.txt", [f"{k}: {', '.join(v)}" for k, v in report.items()])

    def modality(self) -> None:
        table = self.read("behavioural")
        for m in screening.MODALITIES:
            self.write(screening.modality_table(table, m), f"modality_{m}")

    def splits(self) -> None:
        s = self.read("raw").groupBy("participantId", "sessionId").agg(F.first("sessionIndex", ignorenulls=True).alias("sessionIndex"))
        scoring.check_order(s, "participantId", "sessionIndex")
        out = self.write(scoring.session_roles(s, "participantId", "sessionIndex"), "splits")
        sinks.write_csv(out, f"{self.out}/splits_csv")

    def trust(self) -> None:
        """Verification of each modality on the windows of one device family: all identities, fixed ones, and label controls."""
        whole = each = None
        for m in screening.MODALITIES:
            t = self.read(f"modality_{m}")
            if self.family != "all" and "deviceFamily" in t.columns:
                t = explore.of_family(t, self.family, "deviceFamily", "window_start_s")
            results = verify(t, self.read("splits"), self.ks, lambda df, name, m=m: self.write(df, f"trust_parts/{m}/{name}"), self.seeds)
            if results is None:
                continue
            a, b = (r.withColumn("modality", F.lit(m)) for r in results)
            whole = a if whole is None else whole.unionByName(a)
            each = b if each is None else each.unionByName(b)
        if whole is not None:
            sinks.write_results(self.write(whole, "trust"), f"{self.out}/trust_csv")
            self.write(each, "trust_identities")


def verify(table: DataFrame, splits: DataFrame, ks: tuple[int, ...], keep, seeds: tuple[int, ...] = (), stride: int = 1) -> tuple[DataFrame, DataFrame] | None:
    """Results by k and identity set, and AUCs by identity, of a modality table; None if there are no features, no probes or fewer than
    two references.  keep(df, name) writes a frame and reads it back, so that each set is scored from tables."""
    t = verification.with_roles(table, splits, "sessionId")
    names = screening.covered(t)
    if not names:
        return None
    ids = ["participantId", "sessionId", "role", "window_index", "window_start_s", "window_end_s"]
    x, fitted = verification.preprocess(t, names, ids)
    rows = keep(x.withColumnsRenamed({"participantId": "pid", "sessionId": "s", "window_start_s": "start", "window_end_s": "end"}), "vectors")
    refs = keep(verification.references(rows), "references")
    if refs.limit(2).count() < 2 or not rows.where("role = 'probe'").take(1):
        return None

    def scored(df: DataFrame, name: str) -> DataFrame:
        return keep(verification.score(verification.trust_vectors(df, ks, stride), refs), name)

    real = scored(rows, "scored")
    fixed = verification.fixed_identities(rows, max(ks))
    sets = [("all_available", real, None), ("fixed_across_k", real, fixed), *((f"control_{s}", scored(verification.shuffled_probes(rows, s), f"scored_{s}"), None) for s in seeds)]
    out = None
    for name, some, only in sets:
        one = verification.evaluate(some, fixed=only).withColumns({"identity_set": F.lit(name), "n_features": F.lit(len(names)), "fitted_on": F.lit(fitted)})
        one = keep(one, f"results_{name}")
        out = one if out is None else out.unionByName(one)
    return out, verification.per_identity(real)


def main(argv: list[str]) -> None:
    options = {a: argv[i + 1] for i, a in enumerate(argv) if a in ("--from", "--schema")}
    places = [a for i, a in enumerate(argv) if not a.startswith("--") and (i == 0 or argv[i - 1] not in ("--from", "--schema"))]
    if len(places) != 2 or "--schema" not in options or options.get("--from", STAGES[0]) not in STAGES:
        raise SystemExit(__doc__)
    try:
        Chain(SparkSession.builder.getOrCreate(), *places, options["--schema"], "--skip-csv" not in argv).run(options.get("--from", STAGES[0]))
    except Halt as e:
        raise SystemExit(str(e)) from e


if __name__ == "__main__":
    main(sys.argv[1:])
