"""Chat formatting after cumulative-snapshot collapse; DataFrame functions only.

Chat logs often hold one row set per request, so that a conversation is stored again and again, each time a few turns
longer.  Every conversation gets rolling SHA-256 hashes of its turn prefixes (role and text of each turn, each
length-prefixed, in turn order); a conversation whose full hash is a proper prefix hash of any other is a snapshot and an
anti-join removes it.  Of conversations with equal turns the smallest conv_id stays.  What stays is rendered as
``<|role|>\\ntext<|end|>\\n`` per turn.

Defined results: rows without conv_id are no conversation and are left out; null role or text count as empty; turns
sort by turn number, null first, then role and text, so that ties and repeated rows have one order; an empty table
gives no rows.  The hash step folds over a conversation's own turns only; prefixes are made distinct with map-side
combination, so a first turn that a third of all conversations share is one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal (conversations with the same turns), turns array of (turn, role, text)."""
    scratch = Scratch(turns.sparkSession, "chat")
    t = turns.where("conv_id is not null").select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    step = "concat(a[size(a) - 1], ':', char_length(t.role), ':', t.role, char_length(t.text), ':', t.text)"
    hashes = F.expr(f"slice(aggregate(turns, array(cast('' as string)), (a, t) -> concat(a, array(sha2({step}, 256)))), 2, size(turns))")
    convs = convs.withColumn("h", hashes).withColumn("full", F.element_at("h", -1))
    convs = scratch.keep(convs, "convs")
    proper = convs.where("size(h) > 1").select(F.explode(F.expr("slice(h, 1, size(h) - 1)")).alias("full")).distinct()
    firsts = convs.groupBy("full").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    stay = firsts.join(proper, "full", "left_anti")
    return convs.drop("full").join(stay, "conv_id").select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_equal", "turns")


def render(maximal: DataFrame) -> DataFrame:
    body = F.expr("concat_ws('', transform(turns, t -> concat('<|', t.role, '|>\n', t.text, '<|end|>\n')))")
    return maximal.select("conv_id", "n_turns", "n_equal", body.alias("rendered"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(maximal_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


OP6_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
c AS (SELECT conv_id, k, count(*) OVER (PARTITION BY conv_id) AS n,
             string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ) OVER (PARTITION BY conv_id ORDER BY k) AS p FROM o),
f AS (SELECT conv_id, n, p FROM c WHERE k = n),
u AS (SELECT p, n, min(conv_id) AS conv_id, count(*) AS n_equal FROM f GROUP BY p, n),
m AS (SELECT u.* FROM u WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.p = u.p AND c.k = u.n AND c.n > u.n))
SELECT m.conv_id, m.n AS n_turns, m.n_equal,
       (SELECT string_agg('<|' || o.role || '|>' || chr(10) || o.text || '<|end|>' || chr(10), '' ORDER BY o.k) FROM o WHERE o.conv_id = m.conv_id) AS rendered
FROM m
"""
