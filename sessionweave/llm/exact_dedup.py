"""Exact dedup by deterministic block naming; DataFrame functions only.

A document's normalised text (characters of ``[\\x20\\x09-\\x0D]`` deleted) is cut into blocks of BLOCK characters.
Distinct blocks are range-sorted, by hash and then by value, and numbered in that order; then names of adjacent blocks are paired and the
distinct pairs sorted into new names, level by level, until a document has one name.  Two documents get the same
name at the same level exactly if all their characters agree, so no equality is ever decided by a hash.  Names belong to
rows, not to ids: each row that goes to naming is written with a number of its own first.

Only blocks that could be equal are sorted: a document whose (length, 64-bit hash) pair is unique differs from every
other document.  Rows meet their pairs under a salt, so a group of copies that holds a third of all texts spreads over tasks.

Defined results: null text counts as empty; empty texts form one group; a null doc_id sorts after all others when a
row to keep is chosen; of rows repeated with the same doc_id and text exactly one is kept; an empty table gives an
empty result; other columns of the input, whatever their names, are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

BLOCK, SALTS = 4096, 16
_SPACE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text):
    out = F.coalesce(text, F.lit(""))
    for c in _SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _sorted_names(scratch: Scratch, distinct: DataFrame, cols: list[str], name: str, to: str) -> DataFrame:
    """Distinct rows with integer names that follow their sort order, by hash and then by value.

    Ranges are cut by the hash, so that the sample of keys that goes to the driver is eight bytes a key, however long blocks
    are, and blocks that begin alike spread over all ranges.  Written, as the bounds come from a sample."""
    ranged = distinct.withColumn("__h", F.xxhash64(*cols)).repartitionByRange("__h").sortWithinPartitions("__h", *cols)
    return scratch.keep(ranged.drop("__h").withColumn(to, F.monotonically_increasing_id()), name)


def _hashed(docs: DataFrame, text_col: str) -> DataFrame:
    """docs as d, and fp, norm, text_sha256, n_chars."""
    text = F.coalesce(F.col(f"d.{text_col}"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d")).select("d", normalised(text).alias("norm"), F.char_length(text).cast("long").alias("n_chars"))
    fp = F.struct(F.octet_length("norm").alias("n"), F.xxhash64("norm").alias("h")).alias("fp")
    return rows.select("d", "norm", "n_chars", fp)


def _twins(docs: DataFrame, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows whose (length, hash) pair another row has too, written with a row_id each; and the rows that have theirs alone.

    The pairs are dealt out by a salt as well, so the texts of a large group of copies spread over all tasks."""
    rows = _hashed(docs, text_col)
    shared = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp")
    shared = scratch.keep(shared, "shared")
    dealt = shared.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    twins = salted.join(dealt.hint("shuffle_hash"), ["fp", "salt"], "left_semi").select("d", "n_chars", F.monotonically_increasing_id().alias("row_id"))
    alone = salted.join(dealt.hint("shuffle_hash"), ["fp", "salt"], "left_anti").select("d", "norm", "n_chars")
    return scratch.keep(twins, "twins"), alone


def _named(twins: DataFrame, text_col: str, block: int, scratch: Scratch) -> DataFrame:
    """row_id, level and name of each twin: equal for two of them exactly if their normalised texts are equal."""
    cuts = F.expr(f"transform(sequence(0, greatest(0, cast(ceil(char_length(norm) / {block}D) as int) - 1)), i -> substring(norm, i * {block} + 1, {block}))")
    pieces = twins.select("row_id", normalised(F.col(f"d.{text_col}")).alias("norm")).select("row_id", F.posexplode(cuts).alias("i", "block"))
    names = _sorted_names(scratch, pieces.select("block").distinct(), ["block"], "names0", "name")
    named = scratch.keep(pieces.join(names, "block").select("row_id", "i", "name"), "named0")
    done, level = [], 0
    while True:
        top = named.groupBy("row_id").agg(F.max("i").alias("top"))
        done.append(top.where("top = 0").join(named, "row_id").select("row_id", F.lit(level).alias("level"), "name"))
        more = top.where("top > 0").select("row_id")
        if not more.take(1):
            break
        pairs = named.join(more, "row_id", "left_semi").groupBy("row_id", F.expr("cast(i div 2 as int)").alias("j")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        level += 1
        names = _sorted_names(scratch, pairs.select("a", "b").distinct(), ["a", "b"], f"names{level}", "name")
        named = scratch.keep(pairs.join(names, ["a", "b"]).select("row_id", F.col("j").alias("i"), "name"), f"named{level}")
    ident = done[0]
    for d in done[1:]:
        ident = ident.unionByName(d)
    return ident


def _grouped(docs: DataFrame, id_col: str, text_col: str, block: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Twins with keep_id, group_size and kept; and the rows that stand alone.  Both hold the input row as d."""
    twins, alone = _twins(docs, text_col, scratch)
    ident = _named(twins, text_col, block, scratch)
    rank = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no"), F.col("doc_id"), F.col("row_id"))
    members = scratch.keep(twins.select("row_id", "n_chars", F.col(f"d.{id_col}").alias("doc_id")).join(ident, "row_id"), "members")
    groups = members.groupBy("level", "name").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
    told = members.join(groups, ["level", "name"]).select("row_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.row_id") == F.col("row_id")).alias("kept"))
    return twins.join(scratch.keep(told, "told"), "row_id"), alone


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    twins, alone = _grouped(docs, id_col, text_col, block, scratch or Scratch(docs.sparkSession, "exact"))
    sha = F.sha2(normalised(F.col(f"d.{text_col}")), 256).alias("text_sha256")
    own = F.col(f"d.{id_col}")
    out = alone.select(own.alias("doc_id"), own.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    return out.unionByName(twins.select(own.alias("doc_id"), "keep_id", "group_size", "kept", sha))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    twins, alone = _grouped(docs, id_col, text_col, block, scratch or Scratch(docs.sparkSession, "exact"))
    return alone.select("d.*").unionByName(twins.where("kept").select("d.*"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
