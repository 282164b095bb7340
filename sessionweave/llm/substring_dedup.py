"""Removal of repeated substrings with suffix arrays over shards.

Every byte covered by a string of LENGTH bytes that also starts anywhere else, in the same document or another, goes.

Sharding.  Each window of LENGTH bytes is assigned to its least GRAM-byte substring (by a content hash): equal windows have
equal anchors, so windows need only meet where their anchor's hash does.  The windows of one anchor occurrence are adjacent
and make one context of at most 2 * LENGTH bytes; there is about one per 80 bytes of text.  Only (hash of the anchor,
fingerprint of the context, place) is shuffled.  Contexts whose anchor occurs once hold no repeat.  Of the others, contexts with the
same anchor and fingerprint are one kind; a kind's first and last place stand for all of its places, so a passage that a third
of all documents share goes on as two.

Segments.  What a kind with two places or more holds is told by the text around both: it is cut out and goes to one shard.  Adjacent
contexts whose places lie in the same two documents at one distance make one run, so the runs of two copies of a document meet as a
whole (cut at every STRIDE bytes).  A kind with one place is told by all kinds with its key, whose segments go to the key's shard.
In a shard of about SHARD bytes the suffixes at windows are sorted by their first LENGTH bytes (``suffix.same_prefix``), and windows
whose common prefix with a neighbour is LENGTH or more are repeats: that alone decides, hashes only say what meets.  What is found
for a kind holds at all of its places.

Splitting.  Most windows of a kind with one place reach beyond what the documents share.  So the contexts of its key are first split
by the windows' offset to the anchor into pieces of 24 windows, keyed by the bytes that all of them have in common; a piece whose
key occurs once holds no repeat, the others are contexts under their new key and are told as those are.  Keys with more than MOST
different pieces (the edge of a passage that very many documents share) are not sorted in one task but split again, into groups
of 4 windows and then of 1; at width 1 a key holds equal windows only.

Defined results: null text counts as empty; texts under LENGTH bytes keep everything; overlapping occurrences count;
repeated rows are occurrences of their own, so their windows are repeats; a null doc_id is a document as any other; an empty
table gives no rows; other columns are untouched.  A text is searched CHUNK windows at a time, so its length has no bound but that of a
value in Spark; the ranges found in a document are gathered in its row, a few numbers for every 80 bytes of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrowtools import lean, slices, small_batches
from .common import Scratch, table
from .suffix import same_prefix

LENGTH, GRAM, SHARD, MOST, WIDTHS, STRIDE, CHUNK = 200, 40, 1_000_000, 2000, (24, 4, 1), 16384, 4_000_000
_U = np.uint64


class Anchors:
    """Least-gram anchors of windows, by a polynomial hash of the bytes with a fixed random table."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.base = length, gram, 0x9E3779B97F4A7C15 | 1
        self.table = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
        self.power = self.inverse = np.ones(1, _U)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            self.power = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, self.base, _U)]), dtype=_U)
            self.inverse = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, pow(self.base, -1, 2**64), _U)]), dtype=_U)

    def find(self, flat: np.ndarray, ends: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, ...]:
        """document, anchor, first and last window (places in flat) and anchor hash of each context; ends: of the documents.

        Windows are taken chunk at a time; a context that two chunks share comes in two parts, each with its own windows."""
        parts = []
        for a in range(0, max(1, len(flat) - self.length + 1), chunk):
            b = min(len(flat), a + chunk + self.length - 1)
            first = int(np.searchsorted(ends, a, side="right"))
            doc, *places, h = self._find(flat[a:b], np.minimum(ends[first : int(np.searchsorted(ends, b)) + 1], b) - a)
            parts.append((doc + first, *(p + a for p in places), h))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _find(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        n, span = len(flat), self.length - self.gram + 1
        none = np.zeros(0, np.int64)
        if n < self.length:
            return none, none, none, none, none
        self._powers(n + 1)
        p = np.concatenate([[_U(0)], np.cumsum(self.table[flat] * self.power[:n], dtype=_U)])
        h = (p[self.gram :] - p[: n - self.gram + 1]) * self.inverse[: n - self.gram + 1]
        del p
        h ^= h >> _U(32)
        h *= _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(29)
        h *= _U(0xA0761D6478BD642F)
        h ^= h >> _U(32)
        low = h & ~_U(0xFFFFFFF) | np.arange(len(h), dtype=_U)  # ties go to the left
        width = 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        at = (low & _U(0xFFFFFFF)).astype(np.int64)
        place = np.arange(len(at))
        doc = np.searchsorted(ends, place, side="right")
        inside = place + self.length <= ends[doc]
        place, at, doc = place[inside], at[inside], doc[inside]
        if not len(place):
            return none, none, none, none, none
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1
        return doc[first], at[first], place[first], place[last], h[at[first]].view(np.int64)


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and the end of each."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends[1:] - ends[0]


def repeated_windows(contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of the contexts occur at another place in the contexts too (a mask over all contexts, each followed by one
    more place), and where each context begins in it."""
    flat = np.frombuffer(b"\xff".join([*contexts, b""]), np.uint8)
    size = np.array([len(c) for c in contexts])
    starts = np.cumsum(size + 1) - size - 1
    long = size >= length
    edges = np.zeros(len(flat) + 1, np.int32)
    edges[starts[long]] += 1
    edges[starts[long] + size[long] - length + 1] -= 1
    places = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
    mark = np.zeros(len(flat), bool)
    mark[places[same_prefix(flat, places, length)]] = True
    return mark, starts


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").withColumn("dk", F.xxhash64("doc_id", "text"))


def repeated_ranges(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """dk, doc_id, a, b: byte ranges [a, b) of documents to remove; ranges overlap."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = _keyed(docs)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        finder = Anchors(length, gram)
        for whole in batches:
            for b in slices(whole, "text", 1_000_000):
                flat, ends = _flat(b.column("text"))
                doc, at, first, last, h = finder.find(flat, ends)
                raw = memoryview(flat.tobytes())
                c = np.fromiter((xxh3_64_intdigest(raw[i:j]) for i, j in zip(first.tolist(), (last + length).tolist(), strict=True)), np.uint64, len(doc)).view(np.int64)
                base = np.concatenate([[0], ends])[doc]
                row = pa.array(doc)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), b.column("dk").take(row), pa.array((at - base).astype(np.int32)), pa.array((first - base).astype(np.int32)), pa.array((last + length - base).astype(np.int32)), pa.array(h), pa.array(c)], ["doc_id", "dk", "a", "s", "e", "h", "c"])

    found = scratch.keep(keyed.mapInArrow(lean(anchors), f"doc_id {kind}, dk long, a int, s int, e int, h long, c long"), "anchors")
    status = scratch.keep(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "status")  # read back, so that a hot anchor's side of the join can be split
    flagged = scratch.keep(found.join(status, "h"), "flagged")
    scratch.release("anchors", "status")
    place = F.struct("dk", "doc_id", "s", "e", "a")
    kinds = flagged.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m"), F.min(place).alias("p"), F.max(place).alias("q"))
    kinds = scratch.keep(kinds.select(F.col("h").alias("key"), F.col("c").alias("ctx"), "m", "p", "q", F.lit(True).alias("open"), (F.col("p.e") - F.col("p.s")).alias("n")), "kinds0")

    # level 0 holds whole contexts; each further one the pieces of those that differ under one key.  What occurs twice is told by the
    # text around its first and last place; what occurs once, by all that is under its key
    marks, parents = [], []
    for level, width in enumerate((*WIDTHS, None)):
        once = F.col("open") & (F.col("m") == 1)
        per_key = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.bool_or(once).alias("once")).where("kinds > 1 and once").select("key", "kinds")
        per_key = scratch.keep(per_key, f"keys{level}")
        limit = most if level else 1  # whole contexts are split at once: most of their windows reach beyond what is shared
        shards = kinds.join(per_key if width is None else per_key.where(F.col("kinds") <= limit), "key")
        marks.append(scratch.keep(_sorted_shards(_segments(kinds.where("open and m > 1"), shards, keyed, length), length), f"marks{level}"))
        scratch.release()
        hot = per_key.where(F.col("kinds") > limit)
        if width is None or not hot.take(1):
            break
        pieces = scratch.keep(_split(kinds.join(hot.select("key"), "key", "left_semi"), keyed, width, length), f"pieces{level}")
        scratch.release()
        parents.append(pieces.select("key", "ctx", "pk", "pc", "i"))
        kinds = scratch.keep(pieces.groupBy("key", "ctx").agg(F.sum("m").alias("m"), F.min("p").alias("p"), F.max("q").alias("q"), F.bool_or("open").alias("open"), F.min("n").alias("n")), f"kinds{level + 1}")
    out = marks.pop()
    while marks:  # from pieces to what they were cut from, level by level
        of = parents[len(marks) - 1]
        up = out.join(of, ["key", "ctx"]).select(F.col("pk").alias("key"), F.col("pc").alias("ctx"), (F.col("i") + F.col("from")).alias("from"), (F.col("i") + F.col("to")).alias("to"))
        out = marks.pop().unionByName(up)
    out = out.select(F.col("key").alias("h"), F.col("ctx").alias("c"), "from", "to")
    return flagged.join(out, ["h", "c"]).select("dk", "doc_id", (F.col("s") + F.col("from")).alias("a"), (F.col("s") + F.col("to") - 1 + length).alias("b"))


def _with_texts(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """text and w (a list) of the documents that wanted(dk, doc_id, w) names; a document that occurs twice comes twice."""
    per = wanted.groupBy(F.col("dk").alias("wk"), F.col("doc_id").alias("wid")).agg(F.collect_list("w").alias("w"))
    return keyed.join(per.hint("shuffle_hash"), (F.col("dk") == F.col("wk")) & F.col("doc_id").eqNullSafe(F.col("wid"))).select("text", "w")


def _segments(twice: DataFrame, shards: DataFrame, keyed: DataFrame, length: int) -> DataFrame:
    """key, text, marks (the kinds whose windows are told by what the text holds: key, ctx, o, n) of texts to sort; segments with one
    key meet in one shard.  twice: kinds (key, ctx, m, p, q, n) that occur at p and at q; shards: all kinds of keys that meet as such."""
    # a run: adjacent contexts of p's document whose q is in one other document, at one distance
    by = Window.partitionBy("p.dk", "p.doc_id").orderBy("p.s", "p.e")
    fits = (F.lag("p.e").over(by) - length + 1 == F.col("p.s")) & (F.lag("q.dk").over(by) == F.col("q.dk")) & F.lag("q.doc_id").over(by).eqNullSafe(F.col("q.doc_id")) & (F.lag(F.col("q.s") - F.col("p.s")).over(by) == F.col("q.s") - F.col("p.s"))
    runs = twice.withColumn("new", F.when(fits, 0).otherwise(1)).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy("p.dk", "p.doc_id", "run", F.expr(f"p.s div {STRIDE}").alias("part")).agg(F.min("p.s").alias("a"), F.max("p.e").alias("b"), F.min("q").alias("q"), F.collect_list(F.struct("key", "ctx", "p.s", "n")).alias("of"))
    runs = runs.withColumn("group", F.xxhash64("dk", "doc_id", "run", "part"))
    none = F.expr("cast(array() as array<struct<key:bigint,ctx:bigint,o:int,n:int>>)")
    first = runs.select("dk", "doc_id", F.struct("group", "a", "b", F.expr("transform(of, x -> struct(x.key as key, x.ctx as ctx, x.s - a as o, x.n as n))").alias("marks")).alias("w"))
    second = runs.select(F.col("q.dk").alias("dk"), F.col("q.doc_id").alias("doc_id"), F.struct("group", F.col("q.s").alias("a"), (F.col("q.s") + F.col("b") - F.col("a")).alias("b"), none.alias("marks")).alias("w"))
    own = F.when(F.col("open") & (F.col("m") == 1), F.array(F.struct("key", "ctx", F.lit(0).alias("o"), "n"))).otherwise(none)
    met = shards.select("p.dk", "p.doc_id", F.struct(F.col("key").alias("group"), F.col("p.s").alias("a"), F.col("p.e").alias("b"), own.alias("marks")).alias("w"))
    texts = _with_texts(keyed, first.union(second).union(met))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [pa.struct([("key", pa.int64()), ("ctx", pa.int64()), ("o", pa.int32()), ("n", pa.int32())])]
        for whole in batches:
            for b in slices(whole, "text", 500_000):
                rows = []
                for text, ws in zip(b.column("text").to_pylist(), b.column("w").to_pylist(), strict=True):
                    raw = (text or "").encode()
                    rows += [(w["group"], raw[w["a"] : w["b"]], w["marks"]) for w in ws]
                cols = list(zip(*rows, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.list_(fields[0])), strict=True)], ["key", "text", "marks"])

    return texts.mapInArrow(lean(cut), "key long, text binary, marks array<struct<key:bigint,ctx:bigint,o:int,n:int>>")


def _sorted_shards(segments: DataFrame, length: int) -> DataFrame:
    """key, ctx, from, to: windows [from, to) of kinds that are repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, list[dict]]] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            own = [(i, k["key"], k["ctx"], k["o"], k["n"]) for i, (_, marks) in enumerate(held) for k in marks]
            if not own:
                return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())], ["key", "ctx", "from", "to"])
            mask, starts = repeated_windows([t for t, _ in held], length)
            of, key, ctx, o, n = (np.array(c, np.int64) for c in zip(*own, strict=True))
            first, many = starts[of] + o, n - length + 1
            total = np.concatenate([[0], np.cumsum(mask)])
            found = total[first + many] - total[first]
            rows = np.flatnonzero(found == many)  # most kinds are repeats as a whole, or not at all
            cols = [key[rows], ctx[rows], np.zeros(len(rows), np.int64), many[rows]]
            some = [(key[r], ctx[r], i, j) for r in np.flatnonzero((found > 0) & (found < many)) for i, j in _runs(mask[first[r] : first[r] + many[r]])]
            if some:
                cols = [np.concatenate([c, np.array(x, np.int64)]) for c, x in zip(cols, zip(*some, strict=True), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, (np.int64, np.int64, np.int32, np.int32), strict=True)], ["key", "ctx", "from", "to"])

        for b in batches:
            for key, text, marks in zip(*(b.column(c).to_pylist() for c in ("key", "text", "marks")), strict=True):
                if size >= SHARD and key != last:
                    yield flush()
                    held, size = [], 0
                held.append((text, marks))
                size, last = size + len(text) + 1, key
        if held:
            yield flush()

    # a row that occurs twice brings its segments twice, which changes nothing: its windows are repeats
    by_key = segments.repartition("key").sortWithinPartitions("key")
    return by_key.mapInArrow(lean(run), "key long, ctx long, from int, to int").distinct()


_PLACE = "struct<dk:bigint,doc_id:{k},s:int,e:int,a:int>"


def _split(kinds: DataFrame, keyed: DataFrame, width: int, length: int) -> DataFrame:
    """Pieces of the contexts of kinds(key, ctx, m, p, q): the windows whose offset to the anchor falls into one group of width.

    key (of the bytes that all windows of the group have in common) and ctx (fingerprint), pk, pc and i (the context it was cut
    from and where), n (bytes), m, whether it is open still, and p and q, its places in the documents."""
    place_type = kinds.schema["p"].dataType
    place = _PLACE.format(k=place_type["doc_id"].dataType.simpleString())
    texts = _with_texts(keyed, kinds.select("p.dk", "p.doc_id", F.struct("key", "ctx", "m", (F.col("open") & (F.col("m") == 1)).alias("open"), "p", "q").alias("w")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        for whole in batches:
            for b in slices(whole, "text", 500_000):
                lists = b.column("w")
                items = lists.flatten()
                owner = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
                raws = [(t or "").encode() for t in b.column("text").to_pylist()]
                row, rows = [], []
                cols = (items.field(c).to_pylist() for c in ("key", "ctx", "m"))
                spots = (items.field("p").field(c).to_pylist() for c in ("s", "e", "a"))
                for k, (of, pk, pc, m, s, e, a) in enumerate(zip(owner.tolist(), *cols, *spots, strict=True)):
                    text = raws[of][s:e]
                    n = len(text) - length + 1
                    i = 0
                    while i < n:
                        g = (a - s - i) // width
                        at = a - s - g * width  # where the window with the group's least offset begins
                        j = min(n - 1, at)
                        core = text[at : at + length - width + 1]
                        row.append(k)
                        rows.append((xxh3_64_intdigest(core + b"%d,%d,%d" % (pk, width, g)) - 2**63, xxh3_64_intdigest(text[i : j + length], seed=1) - 2**63, pk, pc, i, j + length - i, m))
                        i = j + 1
                out = list(zip(*rows, strict=True)) or [[]] * 7
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, types, strict=True)), items.field("open").take(take), items.field("p").take(take), items.field("q").take(take)], ["key", "ctx", "pk", "pc", "i", "n", "m", "open", "p0", "q0"])

    cut = texts.mapInArrow(lean(run), f"key long, ctx long, pk long, pc long, i int, n int, m long, open boolean, p0 {place}, q0 {place}")

    def at(c: str):
        return F.struct(F.col(f"{c}.dk").alias("dk"), F.col(f"{c}.doc_id").alias("doc_id"), (F.col(f"{c}.s") + F.col("i")).alias("s"), (F.col(f"{c}.s") + F.col("i") + F.col("n")).alias("e"), F.col(f"{c}.a").alias("a"))

    return cut.dropDuplicates(["pk", "pc", "i"]).select("key", "ctx", "pk", "pc", "i", "n", "m", "open", at("p0").alias("p"), at("q0").alias("q"))


def _merged(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_ranges(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """docs with r, the ranges to remove (null if none)."""
    ranges = repeated_ranges(docs, scratch, **options)
    per_doc = scratch.keep(ranges.distinct().groupBy("dk", "doc_id").agg(F.collect_list(F.struct("a", "b")).alias("__r")), "ranges")
    scratch.release("flagged", *(f"{n}{i}" for n in ("kinds", "keys", "marks", "pieces") for i in range(len(WIDTHS) + 1)))
    per_doc = per_doc.select(F.col("dk").alias("__k"), F.col("doc_id").alias("__id"), "__r")
    keyed = docs.withColumn("__dk", F.xxhash64("doc_id", "text"))
    return keyed.join(per_doc.hint("shuffle_hash"), (F.col("__dk") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__k", "__id", "__dk")


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the parts of characters at their edges that stay in part."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def removed(docs: DataFrame, digests: bool = False, scratch: Scratch | None = None, **options) -> DataFrame:
    """docs with text cut (characters that would be left in part stay whole), and all other columns;
    with digests: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the exact byte ranges."""
    scratch = scratch or Scratch(docs.sparkSession, "substring")
    joined = _with_ranges(docs, scratch, **options)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] if digests else docs.columns
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                texts, rows = [], []
                for text, found in zip(b.column("text").to_pylist(), b.column("__r").to_pylist(), strict=True):
                    raw = (text or "").encode()
                    spans = _merged(found or [])
                    if not digests:
                        spans = whole_characters(raw, spans)
                    kept, at = [], 0
                    for i, j in spans:
                        kept.append(raw[at:i])
                        at = j
                    kept = b"".join([*kept, raw[at:]])
                    if digests:
                        rows.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
                    else:
                        texts.append(None if text is None else kept.decode())
                if digests:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in names], names)

    if digests:
        return joined.select("doc_id", "text", "__r").mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return joined.select(*names, "__r").mapInArrow(lean(run), docs.schema)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)
