"""Queries of verification, fusion over modalities, controls and takeover traces, over the vectors of the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import hijack, scoring
from ..operators import verification as y
from .base import EV, events, table

E = F.col
WEIGHTS = (("m0", 0.4), ("m1", 0.6))
HELD = y.held_out_tasks(list(range(7)))


def rows(spark, d):
    """Vectors as windows: identity by label, four sessions each (two train, one enrols, one probes)."""
    e = table(spark, d, "embeddings").where("embedding is not null and label is not null")
    role = F.when(E("vec_id") % 4 == 2, "enrol").when(E("vec_id") % 4 == 3, "probe").otherwise("train")
    x = F.transform("embedding", lambda c: c.cast("double"))
    return e.select(E("vec_id").alias("row"), E("label").alias("pid"), (E("label") * 10 + E("vec_id") % 4).alias("s"), role.alias("role"), F.floor(E("vec_id") / 4).alias("window_index"), E("vec_id").cast("double").alias("start"), (E("vec_id") + 2).cast("double").alias("end"), (E("vec_id") % 7).alias("task"), x.alias("x"))


def modalities(spark, d):
    """Two modalities: halves of the vectors, each without a part of the rows."""
    r = rows(spark, d)
    return {"m0": r.where("row % 3 <> 0").withColumn("x", F.slice("x", 1, 32)), "m1": r.where("row % 3 <> 1").withColumn("x", F.slice("x", 33, 32))}


def _refs(tables):
    out = None
    for m, df in tables.items():
        one = y.references(df).withColumn("modality", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


def _weights(spark):
    return spark.createDataFrame(list(WEIGHTS), "modality string, weight double")


def _rounded(scored):
    return scored.withColumns({"score": F.round("score", 7), "z": F.round("z", 7)})


def _rows_scored(spark, d):
    """Each probe row by itself against each reference."""
    r = rows(spark, d)
    t = r.where("role = 'probe'").select(F.lit(1).alias("k"), "pid", "s", "row", "task", E("row").alias("trust_id"), (E("end") - E("start")).alias("span"), "x")
    return _rounded(y.score(t, y.references(r)))


def verification_sweep(spark, d):
    r = rows(spark, d)
    out = y.evaluate(_rounded(y.score(y.trust_vectors(r, (1, 3), 2), y.references(r))))
    return out.select("k", "n_comparisons", "n_trust_windows", "n_probe_identities", "n_reference_identities", "median_span_s", *(F.round(c, 6).alias(c) for c in ("auc", "auc_norm", "auc_loo_min", "auc_loo_max")))


def shared_timeline(spark, d):
    t = modalities(spark, d)
    s = y.score_modalities(y.shared_trust(t, (2,)), _refs(t))
    return y.fuse(s, "dynamic").select("trust_id", "cand", "genuine", "span", "n_modalities", F.round("fused", 5).alias("fused"))


def _sessions(spark, d, role="probe"):
    t = modalities(spark, d)
    return y.session_scores(t, _refs(t), _weights(spark), role)


def session_fusion(spark, d):
    return _sessions(spark, d).withColumn("fused", F.round("fused", 5))


def replay(spark, d):
    """Training sessions in place of probes."""
    return _sessions(spark, d, "train").withColumn("fused", F.round("fused", 5))


def fusion_sweep(spark, d):
    t = modalities(spark, d)
    s = y.score_modalities(y.shared_trust(t, (1, 2)), _refs(t))
    f = y.sweep(s, [("m0",), ("m1",), ("m0", "m1")], ("equal", "fixed", "dynamic"), _weights(spark))
    return f.groupBy("combo", "scheme", "k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_modalities"), 6).alias("modalities"), F.round(F.avg(F.when(E("genuine"), E("fused"))), 5).alias("genuine_mean"))


def probe_control(spark, d):
    """Verification with probe sessions claimed by another identity."""
    r = rows(spark, d)
    probes = r.where("role = 'probe'").select("s").distinct()
    moved = y.moved_probes(r, probes.select("s", ((F.floor(E("s") / 10) + 3) % 10 * 10 + E("s") % 10).alias("other")))
    s = _rounded(y.score(y.trust_vectors(moved, (1,)), y.references(r)))
    return scoring.auc(s, ["k"], score="z").select("k", "n1", "n0", F.round("auc", 6).alias("auc"))


def _order_map(df, key, by):
    """key and other: keys in order against keys in another order."""
    a = df.select(key).distinct()
    return a.withColumn("o", F.row_number().over(Window.orderBy(key))).join(a.select(E(key).alias("other")).withColumn("o", F.row_number().over(Window.orderBy(by, "other"))), "o").drop("o")  # a few keys


def leak_filter(spark, d):
    r = rows(spark, d)
    return y.clean_identities(y.moved_sessions(r, _order_map(r, "s", E("other") * 7919 % 10007)))


def _row_map(r):
    return _order_map(r, "row", E("other") * 7919 % 10007)


def feature_importance(spark, d):
    r = rows(spark, d)
    p = r.where("role = 'probe'").select("row", "x")
    s = y.score(r.where("role = 'probe'").select("pid", "row", E("row").alias("trust_id"), "x"), y.references(r)).select("row", "pid", "cand", "genuine", "score")
    return y.importance(s, p, y.references(r), _row_map(p)).select("j", F.round("drop", 4).alias("drop"))


def pace_permutation(spark, d):
    """Some components of every row taken from another row: distances of the probe rows afterwards."""
    r = rows(spark, d)
    m = y.moved_components(r, [0, 1, 2, 5], _row_map(r))
    return y.score(m.where("role = 'probe'").select("pid", "row", E("row").alias("trust_id"), "x"), y.references(m)).select("row", "cand", F.round("score", 5).alias("score"))


def fixed_over_modalities(spark, d):
    return y.fixed_over(modalities(spark, d), 8)


def fixed_sessions(spark, d):
    return y.fixed_identities(rows(spark, d), 12)


def fused_leave_one_out(spark, d):
    s = _sessions(spark, d).withColumn("score", F.round(-E("fused"), 7))
    return y.leave_one_out_shift(s, [], "score").select("left_out", F.round("auc", 6).alias("auc"), F.round("shift", 6).alias("shift"), "flag")


def weight_basis(spark, d):
    g = events(spark, d).groupBy(E("kind").alias("modality"), (E("k") % 3).alias("k")).agg((F.avg("v") / 100).alias("gap"), F.count_distinct(E("id") % 6).alias("seeds"))
    return y.weight_basis(g).withColumn("weight", F.round("weight", 6))


def seed_stability(spark, d):
    r = events(spark, d).groupBy((E("k") % 4).alias("k"), (E("s") % 3).alias("seed")).agg((F.avg("v") / 100).alias("auc"))
    return y.stability(r).select("k", "seeds", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def control_gap(spark, d):
    e = events(spark, d)
    real = e.groupBy((E("k") % 4).alias("k")).agg((F.max("v") / 100).alias("auc"))
    control = e.groupBy((E("k") % 4).alias("k"), (E("s") % 3).alias("seed")).agg((F.avg("v") / 100).alias("auc"))
    return y.gap(real, control).select("k", F.round("real", 6).alias("real"), F.round("control", 6).alias("control"), "seeds", F.round("gap", 6).alias("gap"))


def same_device(spark, d):
    s = _rows_scored(spark, d)
    devices = s.select("pid").distinct().withColumn("device", E("pid") % 4)
    return scoring.auc(y.same_device(s, devices), ["device"], score="score").select("device", "n1", "n0", F.round("auc", 6).alias("auc"))


def task_holdout(spark, d):
    s = y.by_task_group(_rows_scored(spark, d), HELD)
    return scoring.auc(s, ["task_group"], score="z").select("task_group", "n1", "n0", F.round("auc", 6).alias("auc"))


def rank_table(spark, d):
    t = modalities(spark, d)
    p = None
    for m, df in t.items():
        one = df.where("role = 'probe'").select(F.lit(m).alias("modality"), "pid", "s", F.concat_ws("|", F.lit(m), "row").alias("trust_id"), "x")
        p = one if p is None else p.unionByName(one)
    return y.rank_table(y.score_modalities(p, _refs(t))).select("modality", "pid", "cand", F.round("median_dist", 5).alias("median_dist"), "rank", "n_candidates", "own_rank")


def reference_distances(spark, d):
    return y.reference_distances(_refs(modalities(spark, d))).withColumn("dist", F.round("dist", 5))


def identity_shifts(spark, d):
    return y.shifts(rows(spark, d)).withColumn("shift", F.round("shift", 6))


def shift_outcomes(spark, d):
    """Shift and AUC joined to changes that hold some identities only."""
    s = _rows_scored(spark, d)
    changes = s.select("pid").distinct().where("pid % 2 = 0").unionByName(spark.createDataFrame([(99,)], "pid int").select(E("pid").cast(s.schema["pid"].dataType).alias("pid")))
    return y.with_outcomes(changes, y.shifts(rows(spark, d)), y.per_identity(s.where("pid <> 4"))).select("pid", F.round("shift", 6).alias("shift"), F.round("auc", 6).alias("auc"))


def _takeover(spark, d):
    e = table(spark, d, "embeddings").where("embedding is not null and label is not null")
    x = F.transform("embedding", lambda c: c.cast("double"))
    r = e.select(E("label").alias("pid"), F.lit(1).alias("s"), E("vec_id").alias("start"), (E("vec_id") % 2).alias("half"), F.explode(F.array(*(F.struct(F.lit(m).alias("modality"), F.slice(x, 1 + 32 * i, 32).alias("x")) for i, m in enumerate(("m0", "m1"))))).alias("q")).select("pid", "s", "start", "half", "q.*")
    refs = scoring.mean_vectors(r.where("half = 0"), ["modality", "pid"], "x").select("modality", E("pid").alias("cand"), E("mean").alias("ref"))
    probes = r.where("half = 1")
    return hijack.probe_distances(probes, refs), probes.select("pid").distinct()


def hijack_pairs(spark, d):
    dist, ids = _takeover(spark, d)
    return hijack.hijacks(dist, _weights(spark), ids).withColumn("peak", F.round("peak", 4))


def hijack_control(spark, d):
    dist, ids = _takeover(spark, d)
    return hijack.hijacks(dist, _weights(spark), ids, own=True).withColumn("peak", F.round("peak", 4))


def hijack_gradual(spark, d):
    dist, ids = _takeover(spark, d)
    return hijack.hijacks(dist, _weights(spark), ids, blend=10).withColumn("peak", F.round("peak", 4))


def hijack_summary(spark, d):
    dist, ids = _takeover(spark, d)
    w = _weights(spark)
    return hijack.summary(hijack.hijacks(dist, w, ids), hijack.hijacks(dist, w, ids, own=True)).withColumns({c: F.round(c, 6) for c in ("rate", "false_positives")})


EMB = """WITH RECURSIVE e0 AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS c, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
 e AS (SELECT vec_id AS row, label AS pid, label * 10 + vec_id % 4 AS s, CASE vec_id % 4 WHEN 2 THEN 'enrol' WHEN 3 THEN 'probe' ELSE 'train' END AS role, vec_id // 4 AS wi, vec_id % 7 AS task, i, c FROM e0),
 rf AS (SELECT pid AS cand, i, avg(c) AS m FROM e WHERE role = 'enrol' GROUP BY ALL)"""
_RS = EMB + """, sc AS (SELECT row, pid, cand, any_value(task) AS task, pid = cand AS genuine, round(-sqrt(sum((c - m) * (c - m))), 7) AS score, -sqrt(sum((c - m) * (c - m))) AS raw FROM e JOIN rf ON e.i = rf.i WHERE role = 'probe' GROUP BY row, pid, cand),
 zs AS (SELECT *, round((raw - avg(raw) OVER p) / CASE WHEN stddev_pop(raw) OVER p > 0 THEN stddev_pop(raw) OVER p ELSE 1 END, 7) AS z FROM sc WINDOW p AS (PARTITION BY row))"""
_MOD = EMB + """, mo AS (SELECT 'm0' AS modality, * FROM e WHERE row % 3 <> 0 AND i <= 32 UNION ALL SELECT 'm1', * FROM e WHERE row % 3 <> 1 AND i > 32), mr AS (SELECT modality, pid AS cand, i, avg(c) AS m FROM mo WHERE role = 'enrol' GROUP BY ALL)"""
_W = "CASE modality WHEN 'm0' THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END"
_SESS = _MOD + """, sm AS (SELECT modality, s, pid, i, avg(c) AS c FROM mo WHERE role = '{role}' GROUP BY ALL), sd AS (SELECT modality, s, pid, cand, sqrt(sum((c - m) * (c - m))) AS d FROM sm JOIN mr USING (modality, i) GROUP BY ALL),
 sz AS (SELECT *, (d - avg(d) OVER p) / CASE WHEN stddev_samp(d) OVER p > 0 THEN stddev_samp(d) OVER p ELSE 1 END AS z FROM sd WINDOW p AS (PARTITION BY modality, s)), sf AS (SELECT s, pid, cand, pid = cand AS genuine, sum(z * """ + _W + ") / sum(" + _W + ") AS fused, count(z) AS n_modalities FROM sz GROUP BY ALL)"
_SHARE = _MOD + """, po AS (SELECT s, wi, min(row) AS a, min(row) + 2 AS b FROM mo WHERE role = 'probe' GROUP BY ALL), pn AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY wi) AS rn, count(*) OVER (PARTITION BY s) AS n FROM po),
 tr AS (SELECT x.s, k, x.rn AS f, x.a, l.b FROM pn x, (VALUES {ks}) AS t(k), pn l WHERE l.s = x.s AND l.rn = x.rn + k - 1), tm AS (SELECT modality, tr.s, k, f, pid, (tr.b - tr.a)::DOUBLE AS span, i, avg(c) AS c, count(*) AS nw FROM tr JOIN pn p ON p.s = tr.s AND p.rn >= f AND p.rn < f + k JOIN mo ON mo.s = p.s AND mo.wi = p.wi AND role = 'probe' GROUP BY ALL),
 td AS (SELECT modality, s, k, f, pid, span, cand, any_value(nw) AS nw, sqrt(sum((c - m) * (c - m))) AS d FROM tm JOIN mr USING (modality, i) GROUP BY ALL), tz AS (SELECT *, (d - avg(d) OVER p) / CASE WHEN stddev_samp(d) OVER p > 0 THEN stddev_samp(d) OVER p ELSE 1 END AS z FROM td WINDOW p AS (PARTITION BY modality, s, k, f))"""


def _auc_sql(source: str, by: str, score: str, y_: str = "genuine") -> str:
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    tie = f"PARTITION BY {key}{score}"
    return f"SELECT {key}(count(*) FILTER ({y_}))::DOUBLE AS n1, (count(*) FILTER (NOT {y_}))::DOUBLE AS n0, round((sum(r) FILTER ({y_}) - count(*) FILTER ({y_}) * (count(*) FILTER ({y_}) + 1) / 2.0) / nullif(count(*) FILTER ({y_}) * count(*) FILTER (NOT {y_}), 0), 6) AS auc FROM (SELECT *, rank() OVER ({part}ORDER BY {score}) + (count(*) OVER ({tie}) - 1) / 2.0::DOUBLE AS r FROM {source})" + (f" GROUP BY {by}" if by else "")


def _exact(sql: str) -> str:
    return sql.replace("round(", "(").replace(", 6) AS auc", ") AS auc")


_TAKE = """WITH RECURSIVE e AS (SELECT vec_id, label AS pid, unnest(embedding)::DOUBLE AS c, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL), q AS (SELECT CASE WHEN i <= 32 THEN 'm0' ELSE 'm1' END AS modality, * FROM e),
 rf AS (SELECT modality, pid AS cand, i, avg(c) AS m FROM q WHERE vec_id % 2 = 0 GROUP BY ALL), dd AS (SELECT modality, pid, cand, vec_id, sqrt(sum((c - m) * (c - m))) AS dist FROM q JOIN rf USING (modality, i) WHERE vec_id % 2 = 1 GROUP BY ALL),
 d AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY modality, pid, cand) AS n FROM dd WINDOW w AS (PARTITION BY modality, pid, cand ORDER BY vec_id)), sz AS (SELECT DISTINCT modality, pid, n, greatest(2, n // 2) AS split FROM d WHERE n >= 4),
 pr AS (SELECT a.pid AS a, b.pid AS b, modality, a.split FROM sz a JOIN sz b USING (modality) WHERE {which}),
 tr AS (SELECT a, b, pr.modality, split, dist, i FROM pr JOIN d ON d.modality = pr.modality AND d.pid = a AND d.cand = a AND i < split UNION ALL SELECT a, b, pr.modality, split, dist, i + split FROM pr JOIN d ON d.modality = pr.modality AND d.pid = b AND d.cand = a),
 t AS (SELECT *, min(split) OVER (PARTITION BY a, b) AS sp FROM tr), t2 AS (SELECT *, greatest(2, sp // 2) AS ce FROM t), z AS (SELECT *, (dist - avg(dist) FILTER (i < ce) OVER w) / CASE WHEN stddev_pop(dist) FILTER (i < ce) OVER w > 0 THEN stddev_pop(dist) FILTER (i < ce) OVER w ELSE 1 END AS z FROM t2 WINDOW w AS (PARTITION BY a, b, modality)),
 f AS (SELECT a, b, i, sp, ce, sum(z * """ + _W + ") / sum(" + _W + """) AS f FROM z GROUP BY ALL), r AS (SELECT *, CASE WHEN count(f) OVER w = 5 THEN avg(f) OVER w END AS rolled FROM f WINDOW w AS (PARTITION BY a, b ORDER BY i ROWS 4 PRECEDING)),
 h AS (SELECT a, b, any_value(sp) AS split, count(*) FILTER (i >= sp) AS rows_after, CASE WHEN count(rolled) FILTER (i < ce) >= 2 THEN avg(rolled) FILTER (i < ce) + 3 * stddev_pop(rolled) FILTER (i < ce) END AS th, max(rolled) FILTER (i >= sp) AS peak FROM r GROUP BY a, b),
 g AS (SELECT r.a, r.b, i, coalesce(rolled > th, false) AS f FROM r JOIN h ON r.a = h.a AND r.b = h.b WHERE i >= split), u AS (SELECT *, i - row_number() OVER (PARTITION BY a, b, f ORDER BY i) AS g FROM g), v AS (SELECT a, b, min(i) AS i, count(*) AS n FROM u WHERE f GROUP BY a, b, g), w AS (SELECT a, b, min(i) FILTER (n >= 5) AS hit, max(n) AS n FROM v GROUP BY a, b),
 o AS (SELECT h.a, h.b, split, rows_after, th IS NOT NULL AND peak IS NOT NULL AND hit IS NOT NULL AS detected, CASE WHEN th IS NOT NULL AND peak IS NOT NULL THEN hit - split END AS rows_to_detect, CASE WHEN th IS NOT NULL THEN round(peak, 4) END AS peak, CASE WHEN th IS NOT NULL AND peak IS NOT NULL THEN coalesce(w.n, 0) END AS most_consecutive FROM h LEFT JOIN w ON h.a = w.a AND h.b = w.b)"""
_NEXT = ", nx AS (SELECT x.row, z.row AS other FROM (SELECT row, row_number() OVER (ORDER BY row) AS o FROM (SELECT DISTINCT row FROM e {where})) x JOIN (SELECT row, row_number() OVER (ORDER BY row * 7919 % 10007, row) AS o FROM (SELECT DISTINCT row FROM e {where})) z USING (o))"
SQL = {
    "verification_sweep": EMB + """, w3 AS (SELECT pid, s, i, row, c, row_number() OVER w AS rn, avg(c) OVER f AS m3, count(*) OVER f AS n3, last_value(row) OVER f + 2 - row AS sp3 FROM e WHERE role = 'probe' WINDOW w AS (PARTITION BY s, i ORDER BY row), f AS (PARTITION BY s, i ORDER BY row ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
 tw AS (SELECT 1 AS k, pid, s, rn, i, c, 2::DOUBLE AS span FROM w3 WHERE (rn - 1) % 2 = 0 UNION ALL SELECT 3, pid, s, rn, i, m3, sp3 FROM w3 WHERE n3 = 3 AND (rn - 1) % 2 = 0), sr AS (SELECT k, pid, s, rn, cand, span, pid = cand AS genuine, -sqrt(sum((c - m) * (c - m))) AS raw FROM tw JOIN rf ON tw.i = rf.i GROUP BY ALL),
 sc AS (SELECT *, round(raw, 7) AS score, round((raw - avg(raw) OVER p) / CASE WHEN stddev_pop(raw) OVER p > 0 THEN stddev_pop(raw) OVER p ELSE 1 END, 7) AS z FROM sr WINDOW p AS (PARTITION BY k, s, rn)), a AS (""" + _auc_sql("sc", "k", "score") + "), b AS (" + _auc_sql("sc", "k", "z") + """),
 lo AS (SELECT o.pid AS o, sc.* FROM sc, (SELECT DISTINCT pid FROM sc) o WHERE sc.pid <> o.pid), l AS (""" + _auc_sql("lo", "k, o", "score") + """), n AS (SELECT k, count(*) AS n_comparisons, count(DISTINCT (s, rn)) AS n_trust_windows, count(DISTINCT pid) AS n_probe_identities, count(DISTINCT cand) AS n_reference_identities FROM sc GROUP BY k), md AS (SELECT k, quantile_cont(span, 0.5) AS median_span_s FROM (SELECT k, s, rn, any_value(span) AS span FROM sc GROUP BY ALL) GROUP BY k)
 SELECT n.k, n_comparisons, n_trust_windows, n_probe_identities, n_reference_identities, median_span_s, a.auc, b.auc AS auc_norm, (SELECT min(auc) FROM l WHERE l.k = n.k) AS auc_loo_min, (SELECT max(auc) FROM l WHERE l.k = n.k) AS auc_loo_max FROM n JOIN md ON md.k = n.k JOIN a ON a.k = n.k JOIN b ON b.k = n.k""",
    "shared_timeline": _SHARE.format(ks="(2)") + " SELECT s || '|' || f || '|' || k AS trust_id, cand, pid = cand AS genuine, span, count(z) AS n_modalities, round(sum(z * nw) / sum(nw), 5) AS fused FROM tz GROUP BY s, f, k, pid, cand, span",
    "fusion_sweep": _SHARE.format(ks="(1), (2)") + """, cb AS (SELECT unnest(['m0', 'm1', 'm0+m1', 'm0+m1']) AS combo, unnest(['m0', 'm1', 'm0', 'm1']) AS modality), ff AS (SELECT combo, scheme, k, s, f, cand, pid = cand AS genuine, sum(z * w) / sum(w) AS fused, count(z) AS nm FROM (SELECT *, CASE scheme WHEN 'equal' THEN 1 WHEN 'dynamic' THEN nw ELSE """ + _W + """ END AS w FROM tz JOIN cb USING (modality), (VALUES ('equal'), ('fixed'), ('dynamic')) AS t(scheme)) GROUP BY ALL) SELECT combo, scheme, k, count(*) AS n, round(avg(nm), 6) AS modalities, round(avg(fused) FILTER (genuine), 5) AS genuine_mean FROM ff GROUP BY combo, scheme, k""",
    "session_fusion": _SESS.format(role="probe") + " SELECT s, pid, cand, genuine, round(fused, 5) AS fused, n_modalities FROM sf",
    "replay": _SESS.format(role="train") + " SELECT s, pid, cand, genuine, round(fused, 5) AS fused, n_modalities FROM sf",
    "probe_control": _RS + ", cl AS (SELECT 1 AS k, z, (pid + 3) % 10 = cand AS genuine FROM zs) " + _auc_sql("cl", "k", "z"),
    "leak_filter": EMB + """, s0 AS (SELECT DISTINCT s, pid FROM e), mp AS (SELECT x.s, z.pid AS fake FROM (SELECT s, row_number() OVER (ORDER BY s) AS o FROM s0) x JOIN (SELECT s, pid, row_number() OVER (ORDER BY s * 7919 % 10007, s) AS o FROM s0) z USING (o)), q AS (SELECT DISTINCT fake, e.pid, role FROM e JOIN mp USING (s) WHERE role IN ('enrol', 'probe')), g AS (SELECT fake, pid, count(*) AS n FROM q GROUP BY ALL)
 SELECT fake FROM g WHERE fake IN (SELECT fake FROM q WHERE role = 'enrol') AND fake IN (SELECT fake FROM q WHERE role = 'probe') GROUP BY fake HAVING max(n) = 1""",
    "feature_importance": _RS + _NEXT.format(where="WHERE role = 'probe'") + ", mv AS (SELECT sc.row, sc.cand, genuine, raw, a.i - 1 AS j, (b.c - m) * (b.c - m) - (a.c - m) * (a.c - m) AS dlt FROM sc JOIN nx ON nx.row = sc.row JOIN e a ON a.row = sc.row JOIN e b ON b.row = nx.other AND b.i = a.i JOIN rf ON rf.cand = sc.cand AND rf.i = a.i), ms AS (SELECT j, genuine, -sqrt(greatest(raw * raw + dlt, 0)) AS score FROM mv), au AS (" + _exact(_auc_sql("ms", "j", "score")) + "), ba AS (" + _exact(_auc_sql("sc", "", "raw")) + ") SELECT CAST(j AS INT) AS j, round((SELECT auc FROM ba) - auc, 4) AS \"drop\" FROM au",
    "pace_permutation": EMB + _NEXT.format(where="") + ", e2 AS (SELECT e.row, e.pid, e.role, e.i, CASE WHEN e.i IN (1, 2, 3, 6) THEN o.c ELSE e.c END AS c FROM e JOIN nx ON nx.row = e.row JOIN e o ON o.row = nx.other AND o.i = e.i), r2 AS (SELECT pid AS cand, i, avg(c) AS m FROM e2 WHERE role = 'enrol' GROUP BY ALL) SELECT row, cand, round(-sqrt(sum((c - m) * (c - m))), 5) AS score FROM e2 JOIN r2 ON e2.i = r2.i WHERE role = 'probe' GROUP BY row, cand",
    "fixed_over_modalities": _MOD + ", n AS (SELECT modality, pid, count(DISTINCT row) AS n FROM mo WHERE role = 'probe' GROUP BY ALL HAVING count(DISTINCT row) >= 8) SELECT pid FROM n WHERE (modality, pid) IN (SELECT (modality, cand) FROM mr) GROUP BY pid HAVING count(*) = 2",
    "fixed_sessions": EMB + " SELECT pid FROM e WHERE role = 'probe' GROUP BY pid HAVING count(DISTINCT row) >= 12",
    "fused_leave_one_out": _SESS.format(role="probe") + ", x AS (SELECT *, round(-fused, 7) AS score FROM sf), lo AS (SELECT o.pid AS left_out, x.* FROM x, (SELECT DISTINCT pid FROM x) o WHERE x.pid <> o.pid), l AS (" + _exact(_auc_sql("lo", "left_out", "score")) + "), w AS (" + _exact(_auc_sql("x", "", "score")) + ") SELECT left_out, round(auc, 6) AS auc, round(auc - (SELECT auc FROM w), 6) AS shift, abs(auc - (SELECT auc FROM w)) > 0.03 AS flag FROM l",
    "weight_basis": EV + ", g AS (SELECT kind AS modality, k % 3 AS k, avg(v) / 100 AS gap, count(DISTINCT id % 6) AS seeds FROM ev GROUP BY ALL) SELECT modality, round(greatest(avg(gap) * max(seeds) / 8.0::DOUBLE, 0.001), 6) AS weight FROM g GROUP BY modality",
    "seed_stability": EV + ", r AS (SELECT k % 4 AS k, s % 3 AS seed, avg(v) / 100 AS auc FROM ev GROUP BY ALL) SELECT k, count(auc) AS seeds, round(avg(auc), 6) AS mean, round(stddev_samp(auc), 6) AS sd FROM r GROUP BY k",
    "control_gap": EV + ", r AS (SELECT k % 4 AS k, s % 3 AS seed, avg(v) / 100 AS auc FROM ev GROUP BY ALL), c AS (SELECT k, avg(auc) AS control, count(auc) AS seeds FROM r GROUP BY k), a AS (SELECT k % 4 AS k, max(v) / 100 AS real FROM ev GROUP BY ALL) SELECT a.k, round(real, 6) AS \"real\", round(control, 6) AS control, seeds, round(real - control, 6) AS gap FROM a JOIN c ON a.k = c.k",
    "same_device": _RS + ", d AS (SELECT pid % 4 AS device, genuine, score FROM sc WHERE pid % 4 = cand % 4 AND pid % 4 IN (SELECT p % 4 FROM (SELECT DISTINCT pid AS p FROM sc) GROUP BY p % 4 HAVING count(*) >= 2)) " + _auc_sql("d", "device", "score"),
    "task_holdout": _RS + f", d AS (SELECT *, CASE WHEN task IN ({', '.join(map(str, HELD))}) THEN 'heldout_tasks' ELSE 'seen_tasks' END AS task_group FROM zs) " + _auc_sql("d", "task_group", "z"),
    "rank_table": _MOD + ", d AS (SELECT modality, row, pid, cand, sqrt(sum((c - m) * (c - m))) AS d FROM mo JOIN mr USING (modality, i) WHERE role = 'probe' GROUP BY ALL), g AS (SELECT modality, pid, cand, quantile_cont(d, 0.5) AS md FROM d GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY modality, pid ORDER BY md, cand) AS rank, count(*) OVER (PARTITION BY modality, pid) AS n_candidates FROM g) SELECT modality, pid, cand, round(md, 5) AS median_dist, rank, n_candidates, max(CASE WHEN cand = pid THEN rank END) OVER (PARTITION BY modality, pid) AS own_rank FROM r",
    "reference_distances": _MOD + ", d AS (SELECT x.modality, x.cand AS a, z.cand AS b, sqrt(sum((x.m - z.m) * (x.m - z.m))) AS d FROM mr x JOIN mr z ON x.modality = z.modality AND x.i = z.i AND x.cand < z.cand GROUP BY ALL) SELECT modality, a, b, round(d, 5) AS dist, (rank() OVER (PARTITION BY modality ORDER BY d) + (count(*) OVER (PARTITION BY modality, d) - 1) / 2.0)::DOUBLE AS rank FROM d",
    "identity_shifts": EMB + ", m AS (SELECT pid, role, i, avg(c) AS m FROM e WHERE role <> 'train' GROUP BY ALL HAVING count(*) >= 3), d AS (SELECT a.pid, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM m a JOIN m b ON a.pid = b.pid AND a.i = b.i WHERE a.role = 'enrol' AND b.role = 'probe' GROUP BY a.pid) SELECT pid, round(d, 6) AS shift, rank() OVER (ORDER BY d DESC)::DOUBLE AS rank FROM d",
    "shift_outcomes": _RS + ", m AS (SELECT pid, role, i, avg(c) AS m FROM e WHERE role <> 'train' GROUP BY ALL HAVING count(*) >= 3), d AS (SELECT a.pid, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM m a JOIN m b ON a.pid = b.pid AND a.i = b.i WHERE a.role = 'enrol' AND b.role = 'probe' GROUP BY a.pid), au AS (" + _auc_sql("(SELECT * FROM sc WHERE pid <> 4)", "pid", "score") + "), ch AS (SELECT DISTINCT pid FROM sc WHERE pid % 2 = 0 UNION ALL SELECT 99) SELECT ch.pid, round(d, 6) AS shift, auc FROM ch LEFT JOIN d ON d.pid = ch.pid LEFT JOIN au ON au.pid = ch.pid",
    "hijack_pairs": _TAKE.format(which="a.pid <> b.pid") + " SELECT * FROM o",
    "hijack_control": _TAKE.format(which="a.pid = b.pid") + " SELECT * FROM o",
}
ROWS_ONLY = ("hijack_gradual", "hijack_summary")


def queries() -> dict:
    return {name: globals()[name] for name in (*SQL, *ROWS_ONLY)}
