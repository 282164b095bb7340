"""Session takeover: traces that begin with one identity's rows and go on with another's, fused, and watched for the switch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_fraction
from . import scoring, sequence

ROLL, SIGMA, BAR, CALIBRATION, LEAST_ROWS, SPLIT, BLEND = 5, 3.0, 5, 0.5, 4, 0.5, 10
PAIR = ["a", "b"]


def probe_distances(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """modality, pid, cand, i (place in the session, from 0), n and dist of each row of rows(modality, pid, s, start, x), of each
    identity's first session (least s), against refs(modality, cand, ref)."""
    first = rows.groupBy("pid").agg(F.min("s").alias("s"))
    own = Window.partitionBy("modality", "pid")
    r = rows.join(first, ["pid", "s"]).withColumns({"i": F.row_number().over(own.orderBy("start")) - 1, "n": F.count(F.lit(1)).over(own)})
    met = r.join(refs, "modality")
    return met.select("modality", "pid", "cand", "i", "n", scoring.distance(F.col("x"), F.col("ref")).alias("dist"))


def ordered_pairs(ids: DataFrame, own: bool = False) -> DataFrame:
    """a and b: all ordered pairs of different identities, or (own) each with itself, the control without a switch."""
    a = ids.select(F.col("pid").alias("a")).distinct()
    if own:
        return a.withColumn("b", F.col("a"))
    return scoring.against(a, ids.select(F.col("pid").alias("b")).distinct()).where("a <> b")


def _sides(distances: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a and of b against a's reference, for each pair and modality with enough rows on both sides."""
    d = distances.where(F.col("n") >= LEAST_ROWS)
    cut = F.greatest(F.lit(2), F.floor(F.col("n") * SPLIT)).cast("int")
    sizes = d.select("modality", "pid", "n").distinct()
    p = pairs.join(sizes.select("modality", F.col("pid").alias("a"), F.col("n").alias("na"), cut.alias("split")), "a").join(sizes.select("modality", F.col("pid").alias("b"), F.col("n").alias("nb")), ["b", "modality"])
    p = p.select(*PAIR, "modality", "na", "nb", "split")
    left = p.join(d.where("pid = cand").select("modality", F.col("pid").alias("a"), "i", "dist"), ["a", "modality"])
    right = p.join(d.select("modality", F.col("pid").alias("b"), F.col("cand").alias("a"), "i", "dist"), [*PAIR, "modality"])
    return left, right


def spliced(distances: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, modality, i, dist, post, split: the first half of a's rows, then all of b's."""
    left, right = _sides(distances, pairs)
    keep = [*PAIR, "modality", "split", "dist"]
    head = left.where("i < split").select(*keep, "i", F.lit(False).alias("post"))
    return head.unionByName(right.select(*keep, (F.col("i") + F.col("split")).alias("i"), F.lit(True).alias("post")))


def blended(distances: DataFrame, pairs: DataFrame, width: int = BLEND, chance: Column | None = None) -> DataFrame:
    """As spliced, with width places between in which b's next row is ever more likely to come than a's.

    Place j takes b's next row with a chance of j / (width - 1) if there is one, else a's row at that place, else b's next.  The
    pointer into b's rows is the state of a fold over the places, so no group is handed to Python.  chance is a column over a, b,
    modality and j between 0 and 1; by default a fixed hash of them."""
    left, right = _sides(distances, pairs)
    each = left.select(*PAIR, "modality", "na", "nb", "split").distinct()
    u = F.coalesce(chance, F.lit(0.0)) if chance is not None else hash_fraction(F.col("a"), F.col("b"), F.col("modality"), F.col("j"))
    draws = each.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("b_first", u < F.col("j") / float(max(width - 1, 1)))
    draws = draws.groupBy(*PAIR, "modality", "na", "nb", "split").agg(F.array_sort(F.collect_list(F.struct("j", "b_first"))).alias("draws"))

    def step(state: Column, d: Column) -> Column:
        more_b, more_a = state["p"] < F.col("nb"), F.col("split") + d["j"] < F.col("na")
        take_b = (d["b_first"] & more_b) | (~more_a & more_b)
        none = ~more_a & ~more_b
        item = F.struct(take_b.alias("is_b"), F.when(take_b, state["p"]).otherwise(F.col("split") + d["j"]).cast("int").alias("at"))
        out = F.when(none, state["out"]).otherwise(F.concat(state["out"], F.array(item)))
        return F.struct((state["p"] + F.when(take_b, 1).otherwise(0)).cast("int").alias("p"), out.alias("out"))

    start = F.struct(F.lit(0).alias("p"), F.expr("cast(array() as array<struct<is_b:boolean,at:int>>)").alias("out"))
    mixed = draws.withColumn("state", F.aggregate("draws", start, step))
    picks = mixed.select(*PAIR, "modality", F.posexplode("state.out").alias("place", "pick"))
    keep = [*PAIR, "modality", "split", "dist"]
    head = left.where("i < split").select(*keep, "i", F.lit(False).alias("post"))
    from_a = left.join(picks.where("not pick.is_b").select(*PAIR, "modality", F.col("pick.at").alias("i"), "place"), [*PAIR, "modality", "i"]).select(*keep, (F.col("split") + F.col("place")).alias("i"), F.lit(False).alias("post"))
    from_b = right.join(picks.where("pick.is_b").select(*PAIR, "modality", F.col("pick.at").alias("i"), "place"), [*PAIR, "modality", "i"]).select(*keep, (F.col("split") + F.col("place")).alias("i"), F.lit(True).alias("post"))
    used = mixed.select(*PAIR, "modality", F.col("state.p").alias("used"), F.size("state.out").alias("placed"))
    rest = right.join(used, [*PAIR, "modality"]).where("i >= used").select(*keep, (F.col("split") + F.col("placed") + F.col("i") - F.col("used")).alias("i"), F.lit(True).alias("post"))
    return head.unionByName(from_a).unionByName(from_b).unionByName(rest)


def fused_trace(traces: DataFrame, weights: DataFrame) -> DataFrame:
    """a, b, i, split, calib_end and rolled: z of each modality over its own first rows, weighted mean by place, rolling mean.

    weights(modality, weight)."""
    ends = traces.groupBy(*PAIR).agg(F.min("split").alias("first_split"))
    t = traces.drop("split").join(ends, PAIR).withColumnRenamed("first_split", "split")
    t = t.withColumn("calib_end", F.greatest(F.lit(2), F.floor(F.col("split") * CALIBRATION)).cast("int"))
    w = Window.partitionBy(*PAIR, "modality")
    early = F.when(F.col("i") < F.col("calib_end"), F.col("dist"))
    sd = F.stddev_pop(early).over(w)
    t = t.withColumn("z", (F.col("dist") - F.avg(early).over(w)) / F.when(sd > 0, sd).otherwise(1.0))
    f = scoring.weighted_fusion(t.join(weights.select("modality", F.col("weight").alias("w")), "modality"), [*PAIR, "i", "split", "calib_end"])
    roll = Window.partitionBy(*PAIR).orderBy("i").rowsBetween(-(ROLL - 1), 0)
    return f.select(*PAIR, "i", "split", "calib_end", F.when(F.count("fused").over(roll) == ROLL, F.avg("fused").over(roll)).alias("rolled"))


def outcomes(trace: DataFrame) -> DataFrame:
    """Per pair: split, rows after it, whether and after how many rows the switch is found, the peak after it, and the longest run over
    the threshold; the last two are null where the calibration rows give no threshold."""
    w = Window.partitionBy(*PAIR)
    base = F.when(F.col("i") < F.col("calib_end"), F.col("rolled"))
    t = trace.withColumn("threshold", F.when(F.count(base).over(w) >= 2, F.avg(base).over(w) + SIGMA * F.stddev_pop(base).over(w))).withColumn("pair", F.struct(*PAIR))
    found = sequence.detect(t, F.col("threshold"), F.col("split"), BAR, "pair", "i", "rolled").select(F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), "detected_at", "most_consecutive")
    post = F.when(F.col("i") >= F.col("split"), F.col("rolled"))
    g = t.groupBy(*PAIR).agg(F.first("split").alias("split"), F.count(F.when(F.col("i") >= F.col("split"), 1)).alias("rows_after"), F.max("threshold").alias("threshold"), F.max(post).alias("peak"))
    ok = F.col("threshold").isNotNull() & F.col("peak").isNotNull()
    out = g.join(found, PAIR, "left").withColumn("detected", ok & F.col("detected_at").isNotNull())
    return out.select(*PAIR, "split", "rows_after", "detected", F.when(F.col("detected"), F.col("detected_at") - F.col("split")).alias("rows_to_detect"), F.when(ok, F.col("peak")).alias("peak"), F.when(ok, F.coalesce("most_consecutive", F.lit(0))).cast("long").alias("most_consecutive"))


def hijacks(distances: DataFrame, weights: DataFrame, ids: DataFrame, own: bool = False, blend: int = 0) -> DataFrame:
    """outcomes of every ordered pair, or of each identity's own continuation; with blend, of gradual switches."""
    pairs = ordered_pairs(ids, own)
    traces = blended(distances, pairs, blend) if blend else spliced(distances, pairs)
    return outcomes(fused_trace(traces, weights))


def summary(found: DataFrame, control: DataFrame, seconds_a_row: float = 7.5) -> DataFrame:
    """One row: pairs, those that could be judged, share detected, median rows and seconds to it, false positives of the control."""
    f = found.withColumn("sec", F.col("rows_to_detect") * seconds_a_row)
    judged = F.count(F.when(F.col("most_consecutive").isNotNull(), 1))
    one = f.agg(F.count(F.lit(1)).alias("pairs"), judged.alias("judged"), (F.count(F.when(F.col("detected"), 1)) / F.when(judged > 0, judged)).alias("rate"), F.percentile("rows_to_detect", F.lit(0.5)).alias("median_rows"), F.percentile("sec", F.lit(0.5)).alias("median_s"))
    two = control.agg(F.count(F.lit(1)).alias("controls"), F.avg(F.when(F.col("detected"), 1.0).otherwise(0.0)).alias("false_positives"))
    return one.crossJoin(two)  # one row each
