"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double"
PROSE = "the cat sat on the mat and the dog ran off to the old house by the river where we all live in peace".split()


def sentence(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(PROSE) + (str(r.randrange(50)) if r.random() < 0.5 else "") for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base, passage = sentence(1, 120), sentence(2, 70)
    near = base.split()
    near[60] = "changed"
    texts = [(1, base), (2, base), (3, " ".join(near)), (4, base.replace(" ", "\n")), (5, None), (6, ""), (7, " \t"), (8, "one two"), (8, "one two"), (None, "one two"), (10, sentence(3, 80) + " " + passage + " " + sentence(4, 30)), (11, sentence(5, 40) + " " + passage), (12, sentence(6, 9000)), (13, "übergrößenträger " * 40), (14, "12 34 ..."), (15, sentence(7, 60))]
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "s", 0, True, 0.5) for i, t in texts], DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def text_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_exact_groups(docs, none):
    from sessionweave.llm.exact_dedup import exact_dedup, exact_groups

    rows = text_of(docs)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t), i is None, i or 0))
    for block in (3, 4096):  # many levels of naming, and few
        got = exact_groups(docs, block=block).collect()
        want = Counter((i, min(groups[norm(t)])[2], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
        assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter({hashlib.sha256(k.encode()).hexdigest(): 1 for k in groups})
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_groups(none).count() == 0


def test_near_groups(docs, none):
    from sessionweave.llm.jaccard_join import jaccard_groups, near_dedup

    rows = text_of(docs)
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    link = [[i != j and bool(sets[i]) and len(sets[i] & sets[j]) * 9 >= 4 * (len(sets[i]) + len(sets[j])) for j in range(n)] for i in range(n)]
    for group in (2, 2048):  # blocks, and whole groups
        got = jaccard_groups(docs, group=group).collect()
        assert Counter((r["doc_id"], r["n_links"]) for r in got) == Counter((rows[i][0], sum(link[i])) for i in range(n))
        assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] in (1, 2, 3, 4)} == {1: 1, 2: 1, 3: 1, 4: 1}
    kept = near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15]
    assert jaccard_groups(none).count() == 0


def test_repeated_bytes(docs, none):
    from sessionweave.llm.substring_dedup import removed

    rows = text_of(docs)
    raw = [t.encode() for _, t in rows]
    count = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    want = Counter()
    for (i, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        want[i, len(b), int(gone.sum()), len(edge) // 2, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()] += 1
    for most in (1, 2000):
        assert Counter(tuple(r) for r in removed(docs, digests=True, most=most).collect()) == want
    cut = removed(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert removed(none, digests=True).count() == 0


def test_packing(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    from sessionweave.llm.packing import pack_documents

    path = public_tokenizers.path("word_bpe_49k.json")
    many = docs.unionByName(spark.createDataFrame([(None, "one two", None, None, None, None, None)] * 300, DOCS))  # a length that most rows share, without ids
    got = pack_documents(many, path, with_ids=True).collect()
    tok = Tokenizer.from_file(path)
    pieces = Counter()
    for _, t in text_of(many):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        for s in range(0, len(ids), 4096):
            pieces[len(ids), s, tuple(ids[s : s + 4096])] += 1
    assert Counter((r["doc_tokens"], r["start"], tuple(r["ids"])) for r in got) == pieces
    assert Counter(r["doc_id"] for r in got if r["start"] == 0) == Counter(i for i, _ in text_of(many))
    assert all(r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in got)
    assert len(seqs) <= total // 4096 + 2 + sum(r["length"] > 2048 for r in got)
    assert pack_documents(none, path).count() == 0


def test_language(docs, none):
    from sessionweave.llm.language_id import fit_on, identified, predict_languages

    model = fit_on(docs)
    got = {r["doc_id"]: r for r in predict_languages(docs, model, ["doc_id"]).collect()}
    assert got[1]["lang_pred"] == "en" and 0 <= got[1]["score"] <= 1
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (5, 6, 7, 14))
    assert identified(docs).columns == docs.columns
    assert predict_languages(docs, fit_on(none), ["doc_id"]).where("lang_pred <> 'und'").count() == 0
    assert identified(none).count() == 0


def test_many_languages(spark):
    """Seventy languages, one of them rare, are all learned; the sample doesn't depend on how rows lie."""
    from sessionweave.llm import language_id

    rows = [(1000 * n + i, " ".join(f"{chr(97 + n % 26)}{chr(97 + n // 26)}{w}" for w in ("ba", "do", "ki", "lu")[: 2 + i % 3]), f"l{n:02d}", True) for n in range(70) for i in range(2 if n == 3 else 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score boolean")
    models = [language_id.fit(d.select("text", "lang"), language_id.Scratch(spark, "t"), rows=300) for d in (df, df.repartition(7))]
    assert models[0].langs == models[1].langs == sorted({r[2] for r in rows})
    assert all((a.key == b.key).all() and (a.ratio == b.ratio).all() for a, b in zip(models[0].tables, models[1].tables, strict=True))
    got = language_id.predict_languages(df, models[0], ["doc_id", "lang", "score"], ("lang_pred", "p")).collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)
    assert [language_id.quota([5, 100, 100], 50), language_id.quota([5, 5], 50), language_id.quota([], 5), language_id.quota([9] * 20, 10)] == [22, 5, 0, 0]


def test_language_scores():
    """Known words, backoff and posteriors against plain dictionaries."""
    from sessionweave.llm import language_id as li

    counts = {"en": {"the": 5, "thing": 2, "sea": 1}, "de": {"der": 4, "see": 2, "ding": 1}}
    langs = sorted(counts)
    grams = lambda w, k: [f"<{w}>"[i : i + k] for i in range(len(w) + 3 - k)]
    held = [counts] + [{x: Counter(g for w, n in ws.items() for g in grams(w, k) for _ in range(n)) for x, ws in counts.items()} for k in range(1, li.MAX_N + 1)]

    def table(k):
        words = sorted({w for ws in held[k].values() for w in ws})
        one = (lambda w: li.word_hashes([w])[0]) if k == 0 else (lambda g: None)
        key = {w: one(w) for w in words}
        if k:
            for w in {w for ws in counts.values() for w in ws}:
                key |= dict(zip(grams(w, k), li.gram_hashes([w])[k - 1][1], strict=True))
        at = [(key[w], i, held[k][x][w]) for i, x in enumerate(langs) for w in words if held[k][x].get(w)]
        return li.Table(*(np.array(c, t) for c, t in zip(zip(*at, strict=True), (np.uint64, np.int64, float), strict=True)), len(langs))

    model = li.Model(langs, [3, 5], [table(k) for k in range(li.MAX_N + 1)])

    def log(k, entry, x):
        size = len({w for ws in held[k].values() for w in ws})
        return np.log((held[k][x].get(entry, 0) + li.SMOOTH) / (sum(held[k][x].values()) + li.SMOOTH * (size + 1)))

    def word(w, x):
        if any(w in held[0][y] for y in langs):
            return log(0, w, x)
        for k in range(min(li.MAX_N, len(w) + 2), 0, -1):
            known = [g for g in grams(w, k) if any(g in held[k][y] for y in langs)]
            if known:
                return np.mean([log(k, g, x) for g in known])
        return 0.0

    words = ["the", "der", "thinge", "meer", "s", "zzz", "q", "sea" * 40]
    assert np.allclose(model.words(words), [[word(w, x) for x in langs] for w in words])
    import pyarrow as pa

    lang, score = li.Scorer(model).predict(pa.array(["The der", "meer 12", "zzz", None, "12", "sea " * 50_000, ""]))
    for text, x, p in zip(["the der", "meer", "zzz"], lang, score, strict=False):
        total = [np.log((d + 1) / 10) + sum(word(w, y) for w in text.split()) for y, d in zip(langs, (3, 5), strict=True)]
        assert x == langs[int(np.argmax(total))] and abs(p - 1 / sum(np.exp(t - max(total)) for t in total)) < 1e-6
    assert lang[3:] == ["und", "und", "en", "und"] and score[3] == 0


def test_language_held_out(spark):
    from sessionweave.llm.language_id import op5_language_id

    where = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "lang")
    got = op5_language_id(spark, where).where("held_out").join(truth, "doc_id").where("lang is not null")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_warc_round_trip(spark):
    from sessionweave.llm.common import Scratch
    from sessionweave.llm.warc import read_warc, write_warc

    big = "<p>" + "é" * 900 + "</p>"
    rows = [(1, "http://a/\n x", big), (2, None, big), (3, "http://c", "small"), (4, "http://d", "small"), (5, "http://e", None), (7, "u", big), (7, "u", big), (None, "n", big), (9, "z", "q" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = []
    for _ in range(2):
        scratch = Scratch(spark, "warctest")
        manifest = write_warc(pages, scratch.path("archive"), scratch, file_bytes=200, shard_bytes=2000)
        made.append(sorted(map(tuple, manifest.collect())))
        got = read_warc(manifest, scratch.path("archive"), with_payload=True).collect()
        assert len(got) == len(rows)
        by = defaultdict(list)
        for r in got:
            by[r["page_id"]].append(r)
        assert [by[i][0]["record_type"] for i in (1, 2, 3, 4, 5, None, 9)] == ["revisit", "revisit", "response", "response", "response", "revisit", "response"]
        assert sorted((r["record_type"], r["refers_to"]) for r in by[7]) == [("response", None), ("revisit", 7)]
        assert by[1][0]["refers_to"] == 7 and by[1][0]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest() and by[1][0]["payload_bytes"] == len(big.encode())
        assert by[9][0]["payload"] == b"q" * 200_000 and by[5][0]["payload_bytes"] == 0
    assert made[0] == made[1]  # the same files, byte for byte
    scratch = Scratch(spark, "warctest")
    empty = write_warc(pages.limit(0), scratch.path("archive"), scratch)
    assert read_warc(empty, scratch.path("archive")).count() == 0


def test_warc_shards(spark):
    """An id far from all others makes no large shard, many shards are written, and many tasks read."""
    from sessionweave.llm.common import Scratch
    from sessionweave.llm.warc import read_warc, write_warc

    pages = spark.createDataFrame([(i if i < 199 else 2**61, f"http://x/{i}", "y" * (500 + i), "clash") for i in range(200)], "page_id long, url string, html string, shard string")
    scratch = Scratch(spark, "warctest")
    manifest = write_warc(pages, scratch.path("archive"), scratch, shard_bytes=6000)
    files = sorted(r["file"] for r in manifest.collect())
    assert len(files) >= 19 and max(r["records"] for r in manifest.collect()) <= 12
    back = read_warc(manifest, scratch.path("archive"))
    assert back.rdd.getNumPartitions() > 1
    assert sorted((r["page_id"], r["payload_bytes"]) for r in back.collect()) == sorted((i if i < 199 else 2**61, 500 + i) for i in range(200))


def test_pieces_on_spark(spark, docs, none):
    import public_tokenizers
    import sentencepiece

    from sessionweave.llm.sentencepieces import decode_documents, encode_documents

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter((i, len(ids := lib.encode(t)), sha(",".join(map(str, ids))), sha(lib.decode(ids))) for i, t in text_of(docs))
    assert Counter(map(tuple, encode_documents(docs, path, digests=True).collect())) == want
    back = decode_documents(encode_documents(docs, path), path).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((i, lib.decode(lib.encode(t))) for i, t in text_of(docs))
    assert encode_documents(none, path, digests=True).count() == 0


def test_exact_without_ids(spark):
    """Rows are told apart by numbers of their own: null and text ids, and equal ids with other texts."""
    from sessionweave.llm.exact_dedup import exact_dedup, exact_groups

    df = spark.createDataFrame([(None, "a b"), (None, "ab"), (None, "abc"), ("x", "ab"), ("x", "abc"), ("x", "ab"), ("w", "zz")], "doc_id string, text string")
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_groups(df).collect())
    assert got == Counter([(None, None, 4, True), (None, None, 4, False), ("x", None, 4, False), ("x", None, 4, False), (None, "x", 2, False), ("x", "x", 2, True), ("w", "w", 1, True)])
    assert sorted(r["text"] for r in exact_dedup(df).collect()) == ["a b", "abc", "zz"]


def test_embeddings(spark):
    from sessionweave.llm.embedding_dedup import embedding_groups

    rng = np.random.default_rng(11)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(24)
        for _ in range(10):
            v = centre + 0.12 * rng.standard_normal(24)
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], c % 3))
    rows += [(200, rows[0][1], 0), (200, rows[0][1], 0), (201, [0.0] * 24, 0), (202, None, 0), (203, [float("nan")] * 24, 0), (204, rows[0][1], None), (205, [], 0), (206, [1.0, None], 0), (207, rows[0][1][:5], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    ok = [r[1] is not None and len(r[1]) > 0 and None not in r[1] and r[2] is not None and np.isfinite(np.array(r[1], float)).all() and np.any(r[1]) for r in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float64), np.array(rows[j][1], np.float64)
                link[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98
    comp = list(range(n))
    for _ in range(n):
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
    want = Counter((rows[i][0], int(link[i].sum()), min(rows[j][0] for j in range(n) if comp[j] == comp[i])) for i in range(n))
    assert link.any()
    for block, size in ((4, None), (1024, 10_000)):
        assert Counter(tuple(r)[:3] for r in embedding_groups(df, block=block, code_size=size).collect()) == want
    odd = spark.createDataFrame([(1, [1e-200, 2e-200, 3e-200], 0, 1), (2, [2e-200, 4e-200, 6e-200], 0, 1), (3, [1.0, -2.0, 1.0], 0, 1), (4, [1e200, 2e200, 3e200], 0, 1)], "vec_id long, embedding array<double>, label int, rid int")
    assert sorted(tuple(r)[:3] for r in embedding_groups(odd).collect()) == [(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 2, 1)]
    assert embedding_groups(df.limit(0)).count() == 0


def test_chat(spark):
    from sessionweave.llm.chat_format import maximal_conversations, render

    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 2, "user", "so"), (4, 0, "user", "hi"), (4, 1, "bot", "yo"), (4, 2, "user", "so"), (5, 0, None, None), (6, 0, "user", "h"), (6, 1, "i", ""), (None, 0, "user", "x"), (7, 0, "user", "a"), (7, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["n_equal"], r["rendered"]) for r in render(maximal_conversations(df)).collect()}
    assert sorted(got) == [3, 5, 6, 7]
    assert got[3] == (3, 2, "<|user|>\nhi<|end|>\n<|bot|>\nyo<|end|>\n<|user|>\nso<|end|>\n") and got[7][0] == 2
    assert render(maximal_conversations(df.limit(0))).count() == 0


def test_pages(spark):
    from sessionweave.llm.html_extract import extract_pages

    df = spark.createDataFrame([(1, None, None), (None, "u", "<article><p>Hi&amp;</p></article>"), (1, "u", "")], "page_id long, url string, html string")
    assert sorted((r["text"], r["n_chars"]) for r in extract_pages(df).collect()) == [("", 0), ("", 0), ("Hi&", 3)]
    assert extract_pages(df.limit(0)).count() == 0


def test_pipeline_stages(spark, docs, none):
    """Stages called one after another without writing in between, and the whole run, against brute force."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from sessionweave.llm.substring_dedup import whole_characters

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "substring_dedup", "packing"]
    now = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, "")
        assert now.columns == docs.columns
    kept = [r["doc_id"] for r in now.collect()]
    rows = [(i, t) for i, t in text_of(docs) if re.search(r"[^\W\d_]", t)]  # one language is learned
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    best = {}
    for i, t in sorted(rows, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0)):
        best.setdefault(norm(t), (i, t))
    rows = sorted(best.values(), key=lambda x: (x[0] is None, x[0] or 0))
    grams = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.lower().split() for _, t in rows)]
    stay = []
    for k, g in enumerate(grams):  # classes here are pairs at most, so the first of a class stands for it
        if not any(len(g & grams[j]) * 9 >= 4 * (len(g) + len(grams[j])) for j in range(k)):
            stay.append(rows[k])
    assert sorted(map(str, kept)) == sorted(str(i) for i, _ in stay)
    raw = [t.encode() for _, t in stay]
    count = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    tok, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for (i, _), b in zip(stay, raw, strict=True):
        gone = np.zeros(len(b), np.int8)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = 1
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        for x, y in whole_characters(b, list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))[::-1]:
            b = b[:x] + b[y:]
        want[i, len(tok.encode(b.decode(), add_special_tokens=False).ids) + 1] += 1
    got = corpus_pipeline.run_on(spark, docs).collect()
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == want
    assert corpus_pipeline.run_on(spark, none).count() == 0
