"""Token codecs, suffix arrays, shingles, filters and page rules against libraries and brute force; no Spark needed."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from sessionweave.llm import packing
from sessionweave.llm.html_extract import extract
from sessionweave.llm.suffix import permuted_lcp, suffix_array

tokenizers = pytest.importorskip("public_tokenizers")

ODD = ["", " ", "   ", "a  b   c ", "▁x ▁ y", "日本語 テスト", "é́ \x00 \t\n 😀 ßẞ", "x" * 700 + " " + "ab" * 400, " " * 40 + "q" + " " * 33, "��", "\n\n a\n b",
       "It's we'll 'S don't’t ²½ x_y a b İI Σας ὈΔ é café, ``''--<|endoftext|> 12345 \x1c a", "<|startoftext|>hi", "naïve Ünïcode — “q” …€5", "a\x0bb\x85c", "Ÿ ÀÉ ǅ ŉ"]


def words(seed: int, n: int = 400) -> list[str]:
    r = random.Random(seed)
    return [" ".join("".join(r.choice("abcdeéßtihn'.,1") for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(0, 30))) for _ in range(n)] + ODD


def long_words(seed: int) -> list[str]:
    """Words beyond the size up to which words are merged together: runs, periods, and text without a space."""
    r = random.Random(seed)
    return ["a" * 3001, "ab" * 1500 + "a", "aab" * 900, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5000)), "".join(r.choice("theandofinto") for _ in range(4000)), "".join(r.choice("ßéab") for _ in range(2500))]


def split(flat, cut):
    return [flat[cut[k] : cut[k + 1]].tolist() for k in range(len(cut) - 1)]


def test_word_tokens_equal_the_library():
    from tokenizers import Tokenizer

    from sessionweave.llm.word_tokens import WordTokenizer

    path = tokenizers.path("word_bpe_49k.json")
    texts = words(1) + long_words(4)
    tok = WordTokenizer(path)
    lib = Tokenizer.from_file(path)
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # new chunks, then kept ones
        assert split(*tok.encode(pa.array(texts, pa.string()))) == want
    assert tok.known


def test_sentencepiece_equals_the_library():
    import sentencepiece

    from sessionweave.llm.sentencepieces import Pieces

    path = tokenizers.path("piece_bpe_32k.model")
    lib, own, texts = sentencepiece.SentencePieceProcessor(model_file=path), Pieces(path), words(2) + long_words(5)
    got = split(*own.encode(pa.array(texts, pa.string())))
    assert got == lib.encode(texts)
    assert [own.decode(x) for x in got] == [lib.decode(x) for x in got]
    r = random.Random(3)
    for _ in range(500):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), r.choice([0, 1, 2])]) for _ in range(r.randrange(8))]
        assert own.decode(ids) == lib.decode(ids)


@pytest.mark.parametrize(("many", "few", "short"), [(1024, 4096, 2), (2, 4096, 2), (2, 1, 2), (1024, 4096, 32768)])
def test_suffix_arrays(monkeypatch, many, few, short):
    """Names in one digit and in two, buckets counted in both ways, and the recursion's end by doubling."""
    from sessionweave.llm import suffix

    for name, value in (("MANY", many), ("FEW", few), ("SHORT", short)):
        monkeypatch.setattr(suffix, name, value)
    rng = np.random.default_rng(1)
    for it in range(400):
        t = np.append(rng.integers(1, 2 + it % 4, rng.integers(1, 60)), 0)
        if it % 3 == 0:
            t = np.append(np.tile(t[:-1][:5], 9), 0)
        s = suffix_array(t)
        assert s.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        raw = t.astype(np.uint8)
        lcp = permuted_lcp(raw, s)
        for a, b in zip(s[1:], s[:-1], strict=True):
            n = 0
            while max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
                n += 1
            assert lcp[a] == n


def test_patterns_hold_every_piece_once():
    r = random.Random(5)
    for n in (1, 7, 400):
        hist: dict[int, int] = {}
        for _ in range(n):
            k = r.choice([64, r.randrange(1, 65)])
            hist[k] = hist.get(k, 0) + 1
        pats = packing.histogram_patterns(hist, 64)
        held: dict[int, int] = {}
        for p, c in pats:
            assert sum(p) <= 64 and list(p) == sorted(p, reverse=True)
            for k in p:
                held[k] = held.get(k, 0) + c
        assert held == hist
    assert packing.histogram_patterns({}, 64) == []


def test_filters_find_all_near_vectors():
    from sessionweave.llm.embedding_dedup import code_for, reach

    rng = np.random.default_rng(7)
    for dim, vectors in ((1, 0), (2, 0), (3, 0), (16, 0), (64, 0), (3, 10**6), (64, 2000), (64, 10**4), (24, 10**5)):
        code = code_for(dim, vectors)
        x = rng.standard_normal((300, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = x + 0.19 * rng.standard_normal((300, dim)) / np.sqrt(dim)
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        best, s = code.best(x, 0)
        row, f = code.decode(y, 0, reach(code.start, dim, 0.98))
        stored = set(zip(row.tolist(), f.tolist(), strict=True))
        for i in range(300):
            if s[i] >= code.start and x[i] @ y[i] >= 0.98:
                assert (i, int(best[i])) in stored


SENTENCES = ["The end of the day and the house in the wood was far off.", "Il gatto di casa sta sul tetto e non scende mai perché ha paura del cane.", "Er ist mit dem Zug in die Stadt und hat auf dem Weg ein Buch an der Bar."]


def page(r: random.Random) -> tuple[str, list[str]]:
    """A random page whose parts are known: its html and the blocks of its article."""
    want: list[str] = []

    def paragraph(keep: bool) -> str:
        words = r.choice(SENTENCES) if r.random() < 0.7 else r.choice(["Short.", "One two", "x &amp; y"])
        text = f"{words} {r.randrange(1000)}"
        if keep:
            want.append(text.replace("&amp;", "&"))
        inner = text.replace(" ", r.choice([" ", "  ", "\n", " <b>"]), 1)
        if r.random() < 0.2:
            inner = f"<a href=/x>{inner}</a>"
        return r.choice([f"<p>{inner}</p>", f"<p>{inner}", f"<div>{inner}</div>", f"<ul><li>{inner}</ul>", f"<blockquote class='no-sidebar'>{inner}</blockquote>", f"<table><tr><td>{inner}</table>"])

    def noise() -> str:
        p = paragraph(False)
        return r.choice([f"<nav>{p}</nav>", f"<div class='ad-slot top'>{p}</div>", f"<div id=comments>{p}{paragraph(False)}</div>", f"<aside><article>{p}</article></aside>", f"<form>{p}<button>Go</button></form>", "<script>var a = '<p>';</script>", f"<!-- {p} -->", f"<footer>{p}</footer>", f"<section class='cookieNotice'>{p}</section>", f"<div role=navigation>{p}</div>"])

    body = "".join(noise() if r.random() < 0.4 else paragraph(True) for _ in range(r.randrange(1, 8)))
    if not any(len(t.split()) > 10 for t in want):  # an article that pass one can tell
        want.append(SENTENCES[0])
        body += f"<p>{SENTENCES[0]}</p>"
    whole = f"<article>{body}</article>"
    for _ in range(r.randrange(3)):
        whole = r.choice(["<div class='page no-sidebar'>{}</div>", "<main>{}</main>", "<form id=aspnetForm>{}</form>", "<div class='post with-comments'>{}</div>", "<section>{}</section>", "<div class='main-content'>{}</div>"]).format(whole)
    outside = lambda: "".join(noise() for _ in range(r.randrange(3)))
    return f"<html><head><title>t</title></head><body>{outside()}{whole}{outside()}</body></html>", want


def test_pages_by_construction():
    for seed in range(400):
        html, want = page(random.Random(seed))
        assert extract(html).split("\n") == want, (seed, html)


def test_neighbours_decide(monkeypatch):
    """Short blocks live by their neighbours: without pass two an article loses them."""
    from sessionweave.llm import html_extract as h

    text = f"<article><h2>Head</h2><p>{SENTENCES[0]}</p><p>Short.</p></article>"
    plain = f"<div><a href=a>Home page</a></div><div>Near the menu</div><div><a href=b>More of it</a></div><div><a href=c>And more</a></div><div><p>{SENTENCES[1]}</p></div><div>By the text</div>"
    assert extract(text) == f"Head\n{SENTENCES[0]}\nShort."
    assert extract(plain) == f"{SENTENCES[1]}\nBy the text"
    monkeypatch.setattr(h, "second_pass", lambda found: [b.label == h.TEXT for b in found])
    assert extract(text) == SENTENCES[0]


def test_articles_survive():
    a = SENTENCES[0]
    whole = [f'<div class="page no-sidebar"><p>{a}</p></div>', f'<div class="post with-comments"><article><p>{a}</p></article></div>', f'<form id="aspnetForm"><article><p>{a}</p></article></form>', f'<p class="ad">Buy<p>{a}', f'<article><ul><li class="share">Share<li>{a}</article>', f"<article><p><a href=x>{a}</a></p></article>", f"<article><p hidden>{a}</p></article>", f"<div><a href=x>one two</a></div><p>{a}</p><div><a href=y>three</a></div>"]
    assert [extract(x) for x in whole] == [a] * len(whole)
    assert extract(f'<article><figure class="image-popup"><figcaption>Cap</figcaption></figure><p class="social-history">Then<p>{a}</article>') == f"Cap\nThen\n{a}"
    assert extract("<p>x &am<b>p;</b></p>") == "x &amp;"
    for odd in ("<div>" * 20_000 + "</b></i></span>" * 20_000, "<p>" * 20_000 + "<li>" * 20_000, "</div>" * 50_000, "<table><tr><td>" * 5_000):
        extract(odd)  # in time that grows with the page only


def test_page_rules():
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/x>Menu</a></ul></nav>
    <div class="cookie-notice">We use the cookies of this site and it is to be on all that is in the world</div>
    <article><h1>Title &amp; more</h1><p>Short.<p>The cat   is on\n the mat&nbsp;and it was<br>there.</p><aside>Other</aside><form><p>Name</p></form></article>
    <div class="comments"><p>I like it and it is the best of all that I have read on it</p></div><footer>&copy; x</footer></body>"""
    assert extract(page) == "Title & more\nShort.\nThe cat is on the mat and it was there."
    assert [extract(x) for x in ("", "<", "a < b & c", '<p title="x>y">q</p>', "<script>alert(1)", "<!-- open", "<p>a&#x41;&lt;b&gt; &am", "<p title='>r")] == ["", "<", "a < b & c", "q", "", "", "aA<b> &am", "r"]
    long = "<article>" + "<p>The end of the day and the house in the wood.</p>" * 2000 + "</article>"
    assert extract(long).count("\n") == 1999
