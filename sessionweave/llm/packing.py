"""Packing documents into token sequences: shortest-pack-first over the length histogram.

Documents become token ids and a closing id; what is longer than a sequence is cut into full sequences and a rest.  The
histogram of piece lengths (at most seq_len rows, whatever the corpus) goes to the driver, where lengths are placed
longest first, each into the open pattern with the shortest fill; only counts of patterns are updated.  Patterns then say
for each (length, rank range) which sequences and offset hold it, and pieces look that up by their rank among pieces of
their length.

Ranks are taken in buckets of (length, salt), so a length that a third of all pieces share is dealt over many tasks; the
buckets' counts are summed per length afterwards.

Defined results: null text counts as empty, so the document is the closing id alone; an empty table gives no rows; a null
doc_id keeps its pieces; repeated rows are packed as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrowtools import lean, slices, small_batches
from .common import Scratch, table

SEQ_LEN, END_ID = 4096, 2


def histogram_patterns(hist: dict[int, int], seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences), by longest length first into the shortest open pattern."""
    open_, done, tie = [], [], 0
    for length in sorted((x for x in hist if hist[x] > 0), reverse=True):
        left = hist[length]
        while left:
            if open_ and open_[0][0] + length <= seq_len:
                fill, _, pattern, count = heapq.heappop(open_)
                used = min(left, count)
                if count > used:
                    heapq.heappush(open_, (fill, tie, pattern, count - used))
                    tie += 1
            else:  # as many of this length as fit, in as many new sequences as that fills
                fit = seq_len // length
                used, pattern, fill = max(1, left // fit), (), 0
                if left >= fit:
                    pattern, fill = (length,) * (fit - 1), length * (fit - 1)
                    left -= used * (fit - 1)
            left -= used
            item = (fill + length, tie, (*pattern, length), used)
            tie += 1
            if fill + length == seq_len:
                done.append(item)
            else:
                heapq.heappush(open_, item)
    return [(p, n) for _, _, p, n in sorted(done + open_, key=lambda x: x[1])]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, ranks per sequence), sorted by length and rank.

    Where a pattern holds a length m times, m adjacent slots take the ranks in turn, so that each slot is a range of ranks."""
    rank, rows, seq = {}, [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            first = rank.get(length, 0)
            rows.append((length, first, seq, offset))
            rank[length] = first + n
            offset += length
        seq += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def token_pieces(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids of each piece."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .word_tokens import WordTokenizer

        tok = WordTokenizer(tokenizer_path)
        for whole in batches:
            for b in slices(whole, "text"):
                row, start, size, crc, total, ids = [], [], [], [], [], []
                flat, cut = tok.encode(b.column("text"))
                for k in range(b.num_rows):
                    all_ids = np.append(flat[cut[k] : cut[k + 1]], end_id).astype("<u4")
                    for s in range(0, len(all_ids), seq_len):
                        piece = all_ids[s : s + seq_len]
                        row.append(k)
                        start.append(s)
                        size.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(all_ids))
                        if with_ids:
                            ids.append(piece.astype("int32"))
                cols = [b.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


def pack(pieces: DataFrame, seq_len: int = SEQ_LEN, scratch: Scratch | None = None, rows_a_bucket: int = 50_000) -> DataFrame:
    """The pieces with sequence_id and offset."""
    scratch = scratch or Scratch(pieces.sparkSession, "packing")
    pieces = scratch.keep(pieces.withColumn("__r", F.monotonically_increasing_id()), "pieces")
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most seq_len rows
    where = slots(histogram_patterns(hist, seq_len))
    buckets = max(64, sum(hist.values()) // rows_a_bucket)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("__r"), F.lit(buckets)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("__r")) - 1
    ranked = salted.withColumn("within", within).join(before, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within")).drop("salt", "within", "before", "__r")
    step = 1 << 44
    keys = where[:, 0] * step + where[:, 1]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * step + rank, side="right") - 1
            cols = {n: b.column(n) for n in b.schema.names if n != "rank"}
            cols["sequence_id"] = pa.array(where[at, 2] + rank - where[at, 1], pa.int64())
            cols["offset"] = pa.array(where[at, 3], pa.int64())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.drop("rank").schema)
    return ranked.mapInArrow(lean(look_up), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, with_ids: bool = False, scratch: Scratch | None = None) -> DataFrame:
    return pack(token_pieces(docs, tokenizer_path, seq_len, end_id, with_ids), seq_len, scratch)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
