"""N-gram Jaccard join of texts by MinHash banding.

Texts become sets of word 5-grams, each told by 52 bits of hash: two different n-grams of a pair of texts are taken for one with
a chance of 2e-16 each.  Texts with equal sets are collapsed (told by a 128-bit hash of the whole set) and one
stands for all.  Representatives get BANDS x ROWS MinHash values, numbers chosen for the target recall at the threshold, and
are shuffled on band hashes; a bucket gives star edges to its least member, not pairs, and connected buckets form candidate
groups.  Each group's full sets then meet once, and all pairs of the group are verified on them.  A group of more than
GROUP representatives is cut into blocks, and every two blocks of it are verified by a task of their own, so no task holds
an unbounded group and nothing is capped.

The result is one row per document: class_id (the least doc_id of the component of links), n_links (documents linked directly,
copies included) and kept (the one document that stands for its class).

Defined results: words are lower-cased runs between white space; a text of one to four words is one shingle; null and blank
texts link with nothing; a null doc_id sorts after all others; of rows repeated with the same doc_id and text each is a
document with its own row, all are links of each other, and one is kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtools import lean, slices, small_batches
from .common import Scratch, connected_components, table

THRESHOLD, RECALL, NGRAM, GROUP, DENSE = 0.8, 0.99999, 5, 2048, 32


def intersections(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of a with every set of b.

    Hashes held by many sets go through a matrix product, the others through pairs of their holders."""
    na, nb = len(sets_a), len(sets_b)
    out = np.zeros((na, nb), np.int32)
    h = np.concatenate([*sets_a, *sets_b]) if na + nb else np.zeros(0)
    own = np.repeat(np.arange(na + nb), [len(s) for s in (*sets_a, *sets_b)])
    order = np.argsort(h, kind="stable")  # holders of a hash: first those of a, then those of b
    h, own = h[order], own[order]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(h))
    in_a = np.add.reduceat(own < na, start) if len(h) else start
    in_b = end - start - in_a
    both = (in_a > 0) & (in_b > 0)
    start, in_a, in_b = start[both], in_a[both], in_b[both]
    dense = np.minimum(in_a, in_b) > DENSE
    for k in range(0, int(dense.sum()), 4096):
        s, a, b = (x[dense][k : k + 4096] for x in (start, in_a, in_b))
        left, right = np.zeros((na, len(s)), np.float32), np.zeros((nb, len(s)), np.float32)
        for j, (p, x, y) in enumerate(zip(s, a, b, strict=True)):
            left[own[p : p + x], j] = 1
            right[own[p + x : p + x + y] - na, j] = 1
        out += np.rint(left @ right.T).astype(np.int32)
    s, a, b = start[~dense], in_a[~dense], in_b[~dense]
    pairs = np.cumsum(a * b)
    k = 0
    while k < len(s):
        stop = max(k + 1, int(np.searchsorted(pairs, (pairs[k - 1] if k else 0) + 500_000, side="right")))
        p, x, y = s[k:stop], a[k:stop], b[k:stop]
        of = np.repeat(np.arange(len(p)), x * y)
        i = np.arange(len(of)) - np.repeat(np.cumsum(x * y) - x * y, x * y)
        row, col = own[p[of] + i // y[of]], own[p[of] + x[of] + i % y[of]] - na
        out += np.bincount(row * nb + col, minlength=na * nb).reshape(na, nb).astype(np.int32)
        k = stop
    return out


def linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs have a Jaccard similarity of threshold or more; exact, by whole numbers."""
    t = Fraction(str(threshold))  # 32 bits hold its products with the sizes of sets of up to 10^8 shingles
    both = intersections(sets_a, sets_b)
    total = np.array([len(s) for s in sets_a], np.int32)[:, None] + np.array([len(s) for s in sets_b], np.int32)[None, :]
    return (t.denominator * both >= t.numerator * (total - both)) & (both > 0)


def spanning(mask: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix the least row of its component."""
    label = np.arange(len(mask))
    while True:
        new = np.minimum(label, np.where(mask, label[None, :], len(mask)).min(axis=1, initial=len(mask)))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _sets(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, dk, fp (of the whole set; null if it is empty) and bands of each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        from .shingles import Shingler, band_hashes

        shingler = Shingler(n)
        for whole in batches:
            for b in slices(whole, "text", 2_000_000):
                h, cut = shingler.sets(b.column("text"))
                raw = memoryview(h.tobytes())
                size = np.diff(cut)
                full = np.flatnonzero(size)
                fp = [xxh3_128_digest(raw[8 * i : 8 * j]) if j > i else None for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                got = np.zeros((len(size), bands), np.int64)
                if len(full):
                    got[full] = band_hashes(h, np.append(cut[:-1][full], cut[-1]), bands, rows)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("dk"), pa.array(fp, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * bands, pa.int32()), pa.array(got.ravel()))], ["doc_id", "dk", "fp", "bands"])

    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("dk")).mapInArrow(lean(run), f"doc_id {kind}, dk long, fp binary, bands array<long>")


def jaccard_groups(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = NGRAM, group: int = GROUP, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, dk, class_id, n_links, kept."""
    from .shingles import bands_for

    spark = docs.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark, "jaccard")
    kind = docs.schema["doc_id"].dataType.simpleString()
    bands, rows = bands_for(threshold, recall)
    found = scratch.keep(_sets(docs, n, bands, rows), "sets")
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "dk")
    reps = found.where("fp is not null").groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"), F.first("bands").alias("bands"))
    reps = scratch.keep(reps.select(F.monotonically_increasing_id().alias("rid"), "fp", "n", F.col("o.doc_id").alias("id"), F.col("o.dk").alias("dk"), "bands"), "reps")
    buckets = reps.select("rid", F.explode("bands").alias("k"))
    stars = buckets.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("rid").alias("hub")).where("m > 1").select("k", "hub")
    edges = scratch.keep(buckets.join(stars, "k").where("rid <> hub").select(F.col("rid").alias("a"), F.col("hub").alias("b")).distinct(), "stars")
    groups = scratch.keep(connected_components(scratch, edges, "candidates").select(F.col("node").alias("rid"), F.col("component").alias("grp")), "groups")
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))

    # full sets of the representatives that have candidates
    wanted = reps.join(groups, "rid").join(sizes, "grp").select("rid", "n", F.col("id").alias("wid"), F.col("dk").alias("wk"), "grp", "size")
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("dk"))
    texts = keyed.join(wanted.hint("shuffle_hash"), (F.col("dk") == F.col("wk")) & F.col("doc_id").eqNullSafe(F.col("wid")))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shingles import Shingler

        shingler = Shingler(n)
        for whole in batches:
            for b in slices(whole, "text", 2_000_000):
                h, cut = shingler.sets(b.column("text"))
                got = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rid", "wid", "n", "grp", "size")), got], ["rid", "id", "n", "grp", "size", "grams"])

    sets = texts.select("text", "rid", "wid", "n", "grp", "size").mapInArrow(lean(grams), f"rid long, id {kind}, n long, grp long, size long, grams array<long>")
    sets = scratch.keep(sets.dropDuplicates(["rid"]), "grams")
    scratch.release()

    whole = sets.where(F.col("size") <= group)
    in_one = whole.repartition("grp").sortWithinPartitions("grp", "rid").mapInArrow(lean(_whole_groups(threshold)), f"rid long, root long, links long, class_id {kind}")
    # larger groups: blocks of about half the size, each pair of blocks (i <= j) a task's work
    large = sets.where(F.col("size") > group).withColumn("blocks", F.ceil(F.col("size") * 2 / group).cast("int")).withColumn("mine", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    result = scratch.keep(in_one, "in_one").select("rid", "root", "links", "class_id")
    if large.take(1):
        met = large.select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
        low, high = F.least("mine", "other"), F.greatest("mine", "other")
        met = met.select("grp", (low.cast("long") * F.col("blocks") + high).alias("part"), F.when(F.col("mine") == low, 0).otherwise(1).alias("side"), "rid", "id", "n", "grams")
        got = met.repartition("grp", "part").sortWithinPartitions("grp", "part", "side", "rid").mapInArrow(lean(_block_pairs(threshold)), "rid long, root long, links long")
        got = scratch.keep(got, "blocks")
        forest = scratch.keep(got.where("root is not null").select(F.col("rid").alias("a"), F.col("root").alias("b")), "forest")
        comps = connected_components(scratch, forest, "classes").select(F.col("node").alias("rid"), F.col("component").alias("root"))
        links = got.groupBy("rid").agg(F.sum("links").alias("links"))
        big = large.select("rid", "id").join(comps, "rid", "left").join(links, "rid", "left").select("rid", F.coalesce("root", "rid").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), "id")
        big = scratch.keep(big, "large")
        least = big.groupBy("root").agg(F.min("id").alias("class_id"))
        result = result.unionByName(big.join(least, "root").select("rid", "root", "links", "class_id"))
    found_reps = reps.drop("bands").join(result, "rid", "left")
    per_set = found_reps.select("fp", "n", "id", F.col("dk").alias("rep_dk"), "root", "links", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("root", "rid").alias("cls"))
    # one representative stands for a class: the one with the least doc_id
    top = per_set.groupBy("cls").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "rep_dk")).alias("top"))
    per_set = per_set.join(top, "cls")
    rows_ = found.drop("bands").join(per_set.drop("cls"), "fp", "left")
    standing = F.col("fp").isNull() | (F.col("doc_id").eqNullSafe(F.col("top.id")) & (F.col("dk") == F.col("top.rep_dk")))
    return rows_.select("doc_id", "dk", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce(F.col("links") + F.col("n") - 1, F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), standing.alias("kept"))


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, list]]:
    """Columns of rows with the same keys; rows come sorted by them.  Only one group is in memory."""
    held: dict[str, list] = {}
    now = None
    for b in batches:
        cols = {c: b.column(c).to_pylist() for c in b.schema.names if c != "grams"}
        grams = b.column("grams")
        values, offsets = grams.values.to_numpy(), grams.offsets.to_numpy()
        for i in range(b.num_rows):
            key = tuple(cols[k][i] for k in keys)
            if key != now:
                if held:
                    yield held
                held, now = {c: [] for c in b.schema.names}, key
            for c, v in cols.items():
                held[c].append(v[i])
            held["grams"].append(values[offsets[i] : offsets[i + 1]].copy())
    if held:
        yield held


def _whole_groups(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            nonlocal kind
            for b in batches:
                kind = b.schema.field("id").type
                yield b

        kind = pa.int64()
        out: tuple[list, ...] = ([], [], [], [])
        for g in _grouped(each(), ("grp",)):
            mask = linked(g["grams"], g["grams"], threshold)
            np.fill_diagonal(mask, False)
            label = spanning(mask)
            weight = np.array(g["n"], np.int64)
            least: dict[int, object] = {}
            for i, r in zip(g["id"], label.tolist(), strict=True):
                if i is not None and (least.get(r) is None or i < least[r]):
                    least[r] = i
            out[0].extend(g["rid"])
            out[1].extend(g["rid"][r] for r in label.tolist())
            out[2].extend((mask @ weight).tolist())
            out[3].extend(least.get(r) for r in label.tolist())
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), kind), strict=True)], ["rid", "root", "links", "class_id"])
                out = ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), kind), strict=True)], ["rid", "root", "links", "class_id"])

    return run


def _block_pairs(threshold: float):
    """Links between two blocks, or within one: how many each member has, and a spanning forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _grouped(batches, ("grp", "part")):
            side = np.array(g["side"])
            own = not (side == 1).any()
            n = len(side)
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if own else 1))
            if not len(a) or not len(b):
                continue
            some = linked([g["grams"][i] for i in a], [g["grams"][i] for i in b], threshold)
            mask = np.zeros((n, n), bool)
            mask[np.ix_(a, b)] = some
            if not own:
                mask[np.ix_(b, a)] = some.T
            np.fill_diagonal(mask, False)
            links = mask @ np.array(g["n"], np.int64)
            label = spanning(mask)
            hit = np.flatnonzero(links)
            rid = np.array(g["rid"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rid[hit]), pa.array(rid[label[hit]]), pa.array(links[hit])], ["rid", "root", "links"])

    return run


def near_dedup(docs: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """The rows of docs that stand for their class, with all their columns."""
    scratch = scratch or Scratch(docs.sparkSession, "near")
    groups = jaccard_groups(docs, scratch=scratch, **options)
    groups = scratch.keep(groups.where("kept").select(F.col("doc_id").alias("__id"), F.col("dk").alias("__dk")), "standing")
    again = groups.groupBy("__id", "__dk").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("__id", "__dk")
    keyed = docs.withColumn("__k", F.xxhash64("doc_id", "text"))
    same = (F.col("__k") == F.col("__dk")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    kept = keyed.join(groups.hint("shuffle_hash"), same, "left_semi")
    if not again.take(1):
        return kept.select(*docs.columns)
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "__k"])).select(*docs.columns)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("dk")
