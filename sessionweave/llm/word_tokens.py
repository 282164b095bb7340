"""Token ids of a lower-casing word-level BPE tokenizer, exactly as the tokenizers library gives them.

Texts are split at ASCII white space, which the tokenizer drops, and each distinct chunk is encoded once and kept.  A
chunk of characters up to U+024F and common punctuation, where the file's normaliser is plain lower-casing, is split by
the file's pattern and its words merged in vectorised rounds; a chunk with any other character, or with the string of a
special token, goes to the library, and so does all text if the file's normaliser or pattern is another.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import PairTable, merge_words

# fixed values: the splitting pattern and normaliser of the tokenizer file
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def _safe(c: str) -> bool:
    low = c.lower()
    return unicodedata.category(c)[0] not in "CZM" and len(low) == 1 and ord(low) < 0x250 and unicodedata.normalize("NFC", c) == c


def _ranges(chars: list[int]) -> str:
    out, i = [], 0
    while i < len(chars):
        j = i
        while j + 1 < len(chars) and chars[j + 1] == chars[j] + 1:
            j += 1
        out.append(re.escape(chr(chars[i])) + ("-" + re.escape(chr(chars[j])) if j > i else ""))
        i = j + 1
    return "".join(out)


_LATIN = range(0x250)
_LETTERS = _ranges([i for i in _LATIN if unicodedata.category(chr(i))[0] == "L"])
_NUMBERS = _ranges([i for i in _LATIN if unicodedata.category(chr(i))[0] == "N"])
_UNSAFE = re.compile("[^" + _ranges([i for i in _LATIN if _safe(chr(i))]) + "‐-‧‰-⁞€]")
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
#: class of each character up to U+024F: 0 letter, 1 number, 2 other, 3 for the slow way
_CLASS = np.array([3 if not _safe(chr(i)) or chr(i) == "'" else {"L": 0, "N": 1}.get(unicodedata.category(chr(i))[0], 2) for i in _LATIN] + [3] * 0x600, np.uint8)


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class _Seen(dict):
    """string -> number; a string not seen before is queued."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word):
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Rows:
    """Growing list of integer rows."""

    def __init__(self):
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int32)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.offsets = np.concatenate([self.offsets, (self.offsets[-1] + np.cumsum(size)).astype(np.int32)])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Their values one after another, and where each row's begin (with the end)."""
        got = pa.ListArray.from_arrays(pa.array(self.offsets), pa.array(self.flat)).take(pa.array(rows))
        return got.values.to_numpy(), got.offsets.to_numpy().astype(np.int64)


class WordTokenizer:
    def __init__(self, path: str, most_chunks: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most_chunks
        spec = json.load(open(path))
        split = spec["pre_tokenizer"]["pretokenizers"][0] if spec["pre_tokenizer"].get("pretokenizers") else {}
        model = spec["model"]
        self.known = split.get("pattern") == {"Regex": _PATTERN} and (spec["normalizer"] or {}).get("normalizers") == _NORMALIZERS and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model.get("ignore_merges")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"\Z.")
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.table = PairTable([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], range(len(merges)), [vocab[a + b] for a, b in merges])
        self.known = self.known and all(c in vocab and c + "</w>" in vocab for c in _byte_chars())
        if self.known:
            self.inside, self.last = (np.array([vocab[c + end] for c in _byte_chars()], np.int64) for end in ("", "</w>"))
        self._clear()

    def _clear(self):
        self.chunks, self.chunk_ids, self.words, self.word_ids = _Seen(), Rows(), _Seen(), Rows()

    def _new_words(self):
        raw = [w.encode() for w in self.words.new]
        if raw:
            size = np.array([len(r) for r in raw], np.int64)
            flat, word = np.frombuffer(b"".join(raw), np.uint8), np.repeat(np.arange(len(raw)), size)
            sym = self.inside[flat]
            end = np.cumsum(size) - 1
            sym[end] = self.last[flat[end]]
            got, of = merge_words(sym, word, self.table)
            self.word_ids.add(got, np.bincount(of, minlength=len(raw)))
        self.words.new = []

    def _split_plain(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of chunks one after another, how many each chunk has, and which chunks need the slow way."""
        def kinds(texts: pa.Array):
            ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            flat = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            ends = ends - ends[0]
            lead = np.flatnonzero((flat & 0xC0) != 0x80)
            code = flat[lead].astype(np.int64)
            two = (code >= 0xC0) & (code < 0xE0)
            code[two] = (code[two] & 0x1F) << 6 | flat[lead[two] + 1] & 0x3F
            return flat, lead, np.where(flat[lead] >= 0xE0, 3, _CLASS[np.minimum(code, len(_CLASS) - 1)]), np.searchsorted(lead, ends[:-1])

        _, _, kind, first = kinds(chunks)  # before lower-casing, which can turn an unsafe character into a safe one
        if not len(kind):
            return np.zeros(0, np.int64), np.zeros(len(chunks), np.int64), np.zeros(len(chunks), bool)
        filled = np.diff(np.append(first, len(kind))) > 0
        slow = np.zeros(len(chunks), bool)
        slow[filled] = np.logical_or.reduceat(kind == 3, first[filled])
        slow |= pc.match_substring_regex(chunks, self.special.pattern).to_numpy(zero_copy_only=False)
        chunks, index = chunks.filter(pa.array(filled & ~slow)), np.flatnonzero(filled & ~slow)
        if not len(chunks):
            return np.zeros(0, np.int64), np.zeros(len(slow), np.int64), slow
        flat, lead, kind, first = kinds(pc.utf8_lower(chunks))
        begins = np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == 1)
        begins[first] = True
        at = np.flatnonzero(begins)
        bounds = np.append(lead[at], len(flat)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(flat)))
        owner = np.searchsorted(first, at, side="right") - 1
        coded = pc.dictionary_encode(words)
        numbers = np.fromiter(map(self.words.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        return numbers[coded.indices.to_numpy()], np.bincount(index[owner], minlength=len(slow)), slow

    def _new_chunks(self):
        new = self.chunks.new
        if self.known:
            numbers, count, slow = self._split_plain(pa.array(new, pa.string()))
        else:
            numbers, count, slow = np.zeros(0, np.int64), np.zeros(len(new), np.int64), np.ones(len(new), bool)
        slow = [k for k in np.flatnonzero(slow) if new[k]]
        found = {k: _WORDS.findall(new[k].lower()) for k in slow if self.known and not _UNSAFE.search(new[k]) and not self.special.search(new[k])}
        found = {k: np.array([self.words[w] for w in ws], np.int64) for k, ws in found.items()}
        self._new_words()
        flat, after = self.word_ids.take(numbers)
        cut = after[np.concatenate([[0], np.cumsum(count, dtype=np.int64)])]
        size = np.diff(cut)
        if slow:
            parts, size = np.split(flat, cut[1:-1]), size.copy()
            for k in slow:
                ids = self.word_ids.take(found[k])[0] if k in found else np.array(self.tok.encode(new[k], add_special_tokens=False).ids, np.int32)
                parts[k], size[k] = ids, len(ids)
            flat = np.concatenate(parts)
        self.chunk_ids.add(flat, size)
        self.chunks.new = []

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, without special tokens, and where each text's begin (with the end)."""
        if len(self.chunks) > self.most:
            self._clear()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        parts = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(parts.values.slice(parts.offsets[0].as_py(), parts.offsets[len(texts)].as_py() - parts.offsets[0].as_py()))
        numbers = np.fromiter(map(self.chunks.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        if self.chunks.new:
            self._new_chunks()
        flat, after = self.chunk_ids.take(numbers[coded.indices.to_numpy()])
        offsets = parts.offsets.to_numpy()
        return flat, after[offsets - offsets[0]]
