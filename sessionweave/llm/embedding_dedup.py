"""Near-duplicate embeddings, every pair of a label compared.

Vectors with equal bytes are collapsed first.  The vectors of a label and a length are dealt out to blocks, BLOCKS or fewer unless
those would be too large to hold, and every two blocks are a task's work.  A task multiplies unit vectors in single precision, about
3 ns a pair of 64 components, and compares again in double precision only the pairs whose product is nearer to the threshold
than single precision can err, so no pair is missed.  Tasks return link counts and a spanning forest of the links they found.

Storing each vector under the filters of a product code (``Code``) needs fewer products but many more rows; with 60 000 vectors in
each of 10 labels it had not ended after 200 s, where all products take less.  The code is no longer on op4's path.

Defined results: vectors are compared only when labels are equal and not null and lengths are equal; null or empty vectors, zero
vectors and vectors with null or non-finite components link with nothing; each row, repeated ones too, is a vector of its own;
a null vec_id is no component's name unless the component holds no other; an empty table gives no rows; other columns, whatever
their names, are ignored.  Vectors are scaled by a power of two first, so neither very small nor very large components lose a link.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowtools import lean, small_batches
from .common import Scratch, connected_components, table

THRESHOLD, TABLES, SERVED, SIGMAS = 0.98, 6, 0.9, 5.0
#: blocks of a label that a vector meets, and the least and the most components a block has for that
BLOCKS, SMALL, LARGE = 8, 1 << 20, 1 << 22
TILE = 256, 4096  # pairs whose products are held at once
#: (vectors of the largest label, blocks, bases a block): from each number of vectors on, the code in use.  Of 64 components
#: a vector's cap of queries' filters then holds 0.027, 0.0053, 0.0009 and 0.00017 of all other vectors
CODES = ((0, 2, 1), (1_200, 2, 4), (6_000, 2, 16), (36_000, 3, 8))


class Code:
    """Product code for vectors of dim components: per table and block random orthonormal bases with their negatives."""

    def __init__(self, dim: int, blocks: int = 2, bases: int = 1, tables: int = TABLES, seed: int = 5):
        rng = np.random.default_rng([seed, dim, blocks, bases])
        self.cuts = np.linspace(0, dim, min(blocks, dim) + 1).round().astype(int)
        self.dim, self.tables = dim, []
        for _ in range(tables):
            qs = [[np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(bases)] for d in np.diff(self.cuts)]
            self.tables.append([np.concatenate([x for q in one for x in (q, -q)]) for one in qs])
        self.words = [len(c) for c in self.tables[0]]
        sample = rng.standard_normal((2000, dim))
        sample /= np.linalg.norm(sample, axis=1, keepdims=True)
        #: what the best filter of a table reaches for most directions; from random directions, not from the data
        self.start = float(np.quantile(self.best(sample, 0)[1], 1 - SERVED))

    def parts(self, unit: np.ndarray, t: int) -> list[np.ndarray]:
        return [unit[:, a:b] @ c.T / math.sqrt(len(self.words)) for a, b, c in zip(self.cuts[:-1], self.cuts[1:], self.tables[t], strict=True)]

    def best(self, unit: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Best filter of table t and its product, for each vector."""
        f, s = np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for part in self.parts(unit, t):
            f, s = f * part.shape[1] + part.argmax(axis=1), s + part.max(axis=1)
        return f, s

    def decode(self, unit: np.ndarray, t: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter) for all filters of table t with a product of at least least."""
        some = max(1, 8_000_000 // max(self.words) ** 2)
        if len(unit) > some:  # what is compared at once stays small
            got = [(k, *self.decode(unit[k : k + some], t, least)) for k in range(0, len(unit), some)]
            return np.concatenate([r + k for k, r, _ in got]), np.concatenate([f for _, _, f in got])
        parts = self.parts(unit, t)
        row, f, s = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for k, part in enumerate(parts):
            rest = sum((p.max(axis=1) for p in parts[k + 1 :]), np.zeros(len(unit)))
            hit, j = np.nonzero(part[row] >= (least - rest[row] - s)[:, None])
            row, f, s = row[hit], f[hit] * part.shape[1] + j, s[hit] + part[row[hit], j]
        return row, f


def reach(start: float, dim: int, threshold: float) -> float:
    """Least product with a filter under which a vector is stored for queries whose product is start or more."""
    spread = math.sqrt(max(0.0, (1 - threshold**2) * (1 - min(1.0, start) ** 2)))
    return start * threshold - spread * min(1.0, SIGMAS / math.sqrt(max(1, dim - 1))) - 1e-9


@functools.lru_cache(64)
def code_for(dim: int, vectors: int = 0) -> Code:
    """The code for labels of at most so many vectors."""
    _, blocks, bases = [c for c in CODES if c[0] <= vectors][-1]
    return Code(dim, blocks, bases)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the largest component is between one half and one; cosines stay."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _checked(vectors: DataFrame, width: str) -> DataFrame:
    """vec_id, label, fp, vec (components as bytes); fp and vec are null where a vector can't link."""
    kind, label = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in batches:
            col = b.column("embedding")
            x = col.values.cast(pa.float32() if width == "<f4" else pa.float64(), safe=False).to_numpy(zero_copy_only=False)  # null gives NaN
            ends = col.offsets.to_numpy().astype(np.int64)
            odd, set_ = (np.concatenate([[0], np.cumsum(c)])[ends] for c in (~np.isfinite(x), x != 0))
            ok = (np.diff(odd) == 0) & (np.diff(set_) > 0) & b.column("label").is_valid().to_numpy(zero_copy_only=False) & col.is_valid().to_numpy(zero_copy_only=False)
            data = x.astype(width).tobytes()
            at = (ends * np.dtype(width).itemsize).tolist()
            raw = [data[p:q] if k else None for k, p, q in zip(ok.tolist(), at, at[1:])]
            fp = [v and xxh3_128_digest(repr(lab).encode() + b"/" + v) for lab, v in zip(b.column("label").to_pylist(), raw, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(fp, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "label", "fp", "vec"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(lean(run), f"vec_id {kind}, label {label}, fp binary, vec binary")


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, block: int | None = None, code_size: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept; block: vectors in a block.  code_size has no effect any more."""
    spark = vectors.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "embedding")
    width = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    rows = scratch.keep(_checked(vectors, width), "rows")
    reps = rows.where("fp is not null").groupBy("fp").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("id"))
    reps = scratch.keep(reps.withColumns({"rid": F.monotonically_increasing_id(), "size": F.length("vec")}), "reps")

    held = F.col("m") / F.lit(block) if block else F.col("m") / F.greatest(_holds(SMALL, width), F.least(F.col("m") / BLOCKS, _holds(LARGE, width)))
    groups = reps.groupBy("label", "size").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    groups = scratch.keep(groups.select("label", "size", "m", F.monotonically_increasing_id().alias("g"), F.ceil(held).alias("blocks")), "groups")
    work = groups.agg(F.sum(F.expr("blocks * (blocks + 1) div 2")).alias("tasks"), F.sum(F.expr("m * size * blocks")).alias("bytes")).first()
    parts = max(1, min(work["tasks"] or 0, max(4 * spark.sparkContext.defaultParallelism, (work["bytes"] or 0) >> 26)))
    met = reps.select("label", "size", "rid", "n", "vec").join(groups.drop("m"), ["label", "size"])
    met = met.select("g", F.pmod(F.xxhash64("rid"), "blocks").alias("k"), F.explode(F.expr("sequence(0L, blocks - 1L)")).alias("l"), "rid", "n", "vec")
    met = met.select("g", F.least("k", "l").alias("i"), F.greatest("k", "l").alias("j"), (F.col("k") > F.col("l")).cast("int").alias("side"), "rid", "n", "vec")
    sort = ["g", "i", "j", "side"]
    got = met.repartition(parts, *sort[:3]).sortWithinPartitions(*sort).mapInArrow(lean(_links(threshold, width)), "rid long, root long, links long")
    got = scratch.keep(got, "links")
    forest = scratch.keep(got.where("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")), "forest")
    comps = connected_components(scratch, forest).select(F.col("node").alias("rid"), F.col("component").alias("root"))
    links = got.groupBy("rid").agg(F.sum("links").alias("links"))
    whole = reps.drop("vec", "label", "size").join(links, "rid", "left").join(comps, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    least = whole.groupBy("root").agg(F.min("id").alias("component_id"))
    whole = whole.join(least, "root").select("fp", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "fp").join(whole, "fp", "left")
    name = F.when(F.col("fp").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), name.alias("component_id"), F.coalesce(F.col("vec_id") == name, F.lit(False)).alias("kept"))


def _holds(components: int, width: str) -> Column:
    """How many vectors of size bytes have so many components, one at least."""
    return F.greatest(F.lit(1.0), F.lit(components * np.dtype(width).itemsize) / F.col("size"))


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least place that each place is joined with, once a[i] and b[i] are joined, too."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(further := root[root], root):
            root = further


def linked_pairs(x: np.ndarray, first: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of linked vectors, each pair once: of the first ones with the others, or, if first is 0, of all with each other."""
    unit = np.empty(x.shape, np.float32)
    for k in range(0, len(x), 4096):
        some = _scaled(x[k : k + 4096].astype(np.float64))
        unit[k : k + 4096] = some / np.linalg.norm(some, axis=1, keepdims=True)
    slack = (x.shape[1] + 16) * 2.0**-23  # twice what rounding to single precision can do to a product
    once = max(1, (1 << 20) // x.shape[1])

    def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for k in range(0, len(a), once):
            p, q = (_scaled(x[c[k : k + once]].astype(np.float64)) for c in (a, b))
            out[k : k + once] = np.einsum("ij,ij->i", p, q) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1)) >= threshold
        return out

    held = np.empty(TILE[0] * TILE[1], np.float32)
    for a in range(0, first or len(x), TILE[0]):
        left = unit[a : min(a + TILE[0], first or len(x))]
        for b in range(first or a, len(x), TILE[1]):
            right = unit[b : b + TILE[1]]
            product = np.matmul(left, right.T, out=held[: len(left) * len(right)].reshape(len(left), len(right)))
            at = np.flatnonzero(product >= threshold - slack)
            if not len(at):
                continue
            p, q = np.divmod(at, len(right))
            near = product.ravel()[at] < threshold + slack
            p, q = p + a, q + b
            keep = np.ones(len(at), bool) if first else p < q
            near &= keep
            keep[near] = exact(p[near], q[near])
            yield p[keep], q[keep]


def _links(threshold: float, width: str):
    """For each task's block or two blocks of vectors: links of each vector, and a spanning forest of them."""

    def solve(one: bool, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rid, n, side = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("rid", "n", "side"))
        first = 0 if one else int((side == 0).sum())
        root, links = np.arange(len(rid)), np.zeros(len(rid), np.int64)
        if one or 0 < first < len(rid):
            x = np.concatenate([np.frombuffer(b"".join(b.column("vec").to_pylist()), width).reshape(b.num_rows, -1) for b in held])
            for p, q in linked_pairs(x, first, threshold):
                for own, other in ((p, q), (q, p)):
                    links += np.bincount(own, n[other], len(rid)).astype(np.int64)
                root = _merged(root, p, q)
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(rid[some]), pa.array(rid[root[some]]), pa.array(links[some])], ["rid", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("g", "i", "j")], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()] if len(keys) else []
            for lo, hi in zip(starts, [*starts[1:], len(keys)], strict=True):
                if (key := tuple(keys[lo].tolist())) != now:
                    if held:
                        yield solve(now[1] == now[2], held)
                    held, now = [], key
                held.append(b.slice(lo, hi - lo))
        if held:
            yield solve(now[1] == now[2], held)

    return run


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT r.a AS vec_id, coalesce(min(n.n), 0) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM r LEFT JOIN n ON n.a = r.a GROUP BY r.a
"""
