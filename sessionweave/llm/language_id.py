"""Language identification by word-first backoff.

A word that any language's training text holds scores by its log frequency in each language.  For an unseen word the longest
order of character n-grams, from 5 down to 1, at which any of its n-grams is known scores it.  A document's score is the sum
over all words of the whole text plus log priors; the prediction is the best language, the score its posterior.

The model is fitted on the whole texts of at most FIT_ROWS labelled rows: as many of each language, as far as it has them, and of each
those with the least hash of the text, so a rare language is learned as a frequent one is and the sample doesn't depend on how
rows are dealt out.  All words and n-grams of the sample count.  They are counted in Spark and kept as sorted 64-bit hashes with
sparse rows (language, log ratio to an unseen word), so what is broadcast grows with the sample's vocabulary, not with the corpus
or with words times languages.

Defined results: a null text, or one without a letter, gives ``und`` with score 0, and so does every text if nothing was
learned; ties go to the first language in sorted order; a null doc_id counts as the empty text in the fold rule; rows with a
null lang are predicted and never learned from; where labelled rows hold more than FIT_ROWS languages, the FIT_ROWS most frequent are
learned; repeated rows count as often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrowtools import lean, slices, small_batches
from .common import Scratch, table
from .word_tokens import _Seen

FIT_ROWS, MAX_N, SMOOTH = 8_000, 5, 0.5
NO_LANGUAGE = "und"
_U = np.uint64


def fold(doc_id):
    """crc32 of the doc_id as text, modulo 5; 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def word_hashes(words: list[str]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), _U, len(words))


def gram_hashes(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1 to MAX_N the n-grams of <word>: number of the word, and hash."""
    flat = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    size = np.array([len(w) + 2 for w in words], np.int64)
    owner, left = np.repeat(np.arange(len(words)), size), np.repeat(np.cumsum(size), size) - np.arange(len(flat))
    out, h = [], np.zeros(len(flat), _U)
    for k in range(1, MAX_N + 1):
        h = h[: len(flat) - k + 1] * _U(0x9E3779B97F4A7C15) + flat[k - 1 :]
        fits = left[: len(h)] >= k
        mixed = h[fits] + _U(k)
        for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
            mixed = (mixed ^ mixed >> _U(shift)) * _U(factor)
        out.append((owner[: len(h)][fits], mixed ^ mixed >> _U(32)))
    return out


class Table:
    """Log probabilities of the entries of one order: sorted keys, and for each the languages that hold it, as log ratios to base."""

    def __init__(self, key: np.ndarray, lang: np.ndarray, n: np.ndarray, langs: int):
        order = np.lexsort((lang, key))
        key, self.lang, n = key[order], lang[order].astype(np.int32), n[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.key, self.start = key[first], np.append(first, len(key))
        self.base = math.log(SMOOTH) - np.log(np.bincount(self.lang, weights=n, minlength=langs) + SMOOTH * (len(first) + 1))
        self.ratio = np.log((n + SMOOTH) / SMOOTH).astype(np.float32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where there is none."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)

    def ratios(self, row: np.ndarray, place: np.ndarray, rows: int, langs: int) -> np.ndarray:
        """Sums over the places of each row of their log ratios, by language."""
        size = self.start[place + 1] - self.start[place]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[place], size)
        return np.bincount(np.repeat(row, size) * langs + self.lang[at], weights=self.ratio[at], minlength=rows * langs).reshape(rows, langs)


class Model:
    """Languages, log priors, and tables of words (0) and of n-grams (their order)."""

    def __init__(self, langs: list[str], docs: list[int], tables: list[Table]):
        self.langs, self.tables = langs, tables
        self.prior = np.log(np.array(docs, float) + 1) - math.log(sum(docs) + len(langs)) if langs else np.zeros(0)

    def words(self, words: list[str]) -> np.ndarray:
        """A row of log probabilities for each word."""
        n, out = len(self.langs), np.zeros((len(words), len(self.langs)))
        if not words or not n:
            return out
        at = self.tables[0].find(word_hashes(words))
        known = np.flatnonzero(at >= 0)
        out[known] = self.tables[0].base + self.tables[0].ratios(np.arange(len(known)), at[known], len(known), n)
        rest = np.flatnonzero(at < 0)
        grams = gram_hashes([words[i] for i in rest])
        open_ = np.ones(len(rest), bool)
        for k in range(MAX_N, 0, -1):
            owner, key = grams[k - 1]
            live = open_[owner]
            owner, place = owner[live], self.tables[k].find(key[live])
            owner, place = owner[place >= 0], place[place >= 0]
            count = np.bincount(owner, minlength=len(rest))
            hit = np.flatnonzero(count)
            to = np.zeros(len(rest), np.int64)
            to[hit] = np.arange(len(hit))
            out[rest[hit]] = self.tables[k].base + self.tables[k].ratios(to[owner], place, len(hit), n) / count[hit, None]
            open_[hit] = False
        return out


def quota(counts: list[int], rows: int) -> int:
    """The most rows a language may give, so that all together give at most rows."""
    left = sorted(counts)
    for i, c in enumerate(left):
        share = rows // (len(left) - i)
        if c > share:
            return share
        rows -= c
    return left[-1] if left else 0


def fit(labelled: DataFrame, scratch: Scratch, rows: int = FIT_ROWS) -> Model:
    """Model of labelled(text, lang); lang is not null."""
    spark = labelled.sparkSession
    small_batches(spark)
    texts = labelled.select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 32)).alias("h")).where("text is not null")
    per = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()  # at most rows rows
    share = quota([r["n"] for r in per], rows)
    # the least hashes of a language lie below a bound that leaves some more than its share; then exactly the share
    bounds = [(r["lang"], min(1 << 32, int((1.2 * share + 60) / r["n"] * (1 << 32)) + 1)) for r in per]
    bounds = F.broadcast(spark.createDataFrame(bounds, "lang string, bound long"))
    near = texts.join(bounds, "lang").where(F.col("h") < F.col("bound")).drop("bound")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))  # of at most about 1.2 x rows + 60 x languages
    sample = scratch.keep(near.withColumn("r", rank).where(F.col("r") <= share).select("lang", "text"), "sample")
    docs = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(docs)
    words = sample.select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, count, ws = b.column("lang"), b.column("n"), b.column("w").to_pylist()
            for k, (owner, key) in enumerate([(np.arange(len(ws)), word_hashes(ws)), *gram_hashes(ws)]):
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), pa.array(key.view(np.int64)), lang.take(at), count.take(at)], ["k", "key", "lang", "n"])

    found = words.mapInArrow(lean(entries), "k int, key long, lang string, n long").groupBy("k", "key", "lang").agg(F.sum("n").alias("n")).toArrow()
    number = {x: i for i, x in enumerate(langs)}
    k, key, n = (found.column(c).to_numpy() for c in ("k", "key", "n"))
    coded = pc.dictionary_encode(found.column("lang").combine_chunks())
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    lang = np.array([number[x] for x in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()] if len(found) else np.zeros(0, np.int64)
    return Model(langs, [docs[x] for x in langs], [Table(key[k == i].view(_U), lang[k == i], n[k == i].astype(float), len(langs)) for i in range(MAX_N + 1)])


class Scorer:
    """Scores of texts; each distinct chunk between white space is split into words and scored once, and kept."""

    def __init__(self, model: Model, most_numbers: int = 4_000_000):
        import regex

        self.model, self.most, self.letters_of = model, max(1000, most_numbers // max(1, len(model.langs))), regex.compile(r"\p{L}+")
        self._clear()

    def _clear(self):
        self.seen, self.rows, self.letters = _Seen(), np.zeros((0, len(self.model.langs))), np.zeros(0, bool)

    def _new_chunks(self):
        n = len(self.model.langs)
        found = [self.letters_of.findall(c) for c in self.seen.new]
        count = np.array([len(ws) for ws in found], np.int64)
        words = _Seen()
        used = np.array([words[w] for ws in found for w in ws], np.int64)
        rows = self.model.words(words.new)
        owner = np.repeat(np.arange(len(found)), count)
        new = np.stack([np.bincount(owner, weights=rows[used, k], minlength=len(found)) for k in range(n)], axis=1) if n else np.zeros((len(found), 0))
        self.rows = np.concatenate([self.rows, new])
        self.letters = np.concatenate([self.letters, count > 0])
        self.seen.new = []

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if len(self.seen) > self.most:
            self._clear()
        n, langs = len(texts), self.model.langs
        chunks = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")))
        offsets = chunks.offsets.to_numpy()
        coded = pc.dictionary_encode(chunks.values.slice(offsets[0], offsets[-1] - offsets[0]))
        numbers = np.fromiter(map(self.seen.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        if self.seen.new:
            self._new_chunks()
        used = numbers[coded.indices.to_numpy()]
        owner = np.repeat(np.arange(n), np.diff(offsets))
        letters = np.bincount(owner[self.letters[used]], minlength=n) > 0
        if not langs:
            return [NO_LANGUAGE] * n, np.zeros(n)
        total = np.stack([np.bincount(owner, weights=self.rows[used, k], minlength=n) for k in range(len(langs))], axis=1) + self.model.prior
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [langs[b] if ok else NO_LANGUAGE for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def predict_languages(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns keep of docs with the prediction and its score, under names that keep doesn't hold."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = list(dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for b in slices(whole, "text"):
                lang, score = scorer.predict(b.column("text"))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, *names])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return docs.select(*columns).mapInArrow(lean(run), schema + f"`{names[0]}` string, `{names[1]}` double")


def fit_on(docs: DataFrame, scratch: Scratch | None = None, rows: int = FIT_ROWS) -> Model:
    """Model from the rows of docs with a lang that the fold rule doesn't hold out."""
    return fit(docs.where("lang is not null").where(fold(F.col("doc_id")) != 0), scratch or Scratch(docs.sparkSession, "language"), rows)


def identified(docs: DataFrame, least_score: float = 0.5, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs whose language is told with a posterior of least_score or more, with all their columns."""
    out = predict_languages(docs, fit_on(docs, scratch), docs.columns, ("__lang_pred", "__score"))
    return out.where((F.col("__lang_pred") != NO_LANGUAGE) & (F.col("__score") >= least_score)).select(*docs.columns)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict_languages(docs, fit_on(docs), ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
