"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Gives what the sentencepiece library gives for a BPE model without normalisation rules, with dummy prefix and byte
fallback; the library is only used to read the model file.  White space marks occur only at the beginning of pieces, so
no merge crosses the beginning of a run of spaces: texts fall into units (spaces and what follows them), each distinct
unit is merged once, by ``bpe.merge_words``, and its ids are kept.

Defined results: null text counts as empty; an empty text has no ids and decodes to itself; the space and U+2581 are one
symbol, as in the library; characters that are no piece become byte pieces; on decoding, bytes that are no UTF-8 become
U+FFFD each, control pieces vanish and the unknown piece becomes `` ⁇ ``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .arrowtools import lean, slices, small_batches
from .bpe import PairTable, merge_words
from .common import table
from .word_tokens import Rows, _Seen

MARK = "▁"
_CHAR = 1 << 24  # symbols from here on are characters that are no piece


class Pieces:
    def __init__(self, path: str, most_units: int = 1_000_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece.Type
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models without normalisation, with dummy prefix and byte fallback")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not handled")
        self.surface = [p.piece.replace(MARK, " ") for p in model.pieces]
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.value = {i: b for b, i in self.byte.items()}
        self.control = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.plain_from = 1 + max([*self.value, *self.control, self.unknown])
        self.decimal = [str(i) for i in range(len(self.surface))]
        normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(MARK in s.lstrip(MARK) for s in normal):
            raise ValueError("a piece has white space after its beginning")
        order = {s: r for r, s in enumerate(sorted({s for _, s in normal.values()}, reverse=True))}
        symbol = lambda s: normal[s][0] if s in normal else _CHAR + ord(s) if len(s) == 1 else None
        pairs = [(a, b, order[score], i) for s, (i, score) in normal.items() for k in range(1, len(s)) if (a := symbol(s[:k])) is not None and (b := symbol(s[k:])) is not None]
        self.table = PairTable(*zip(*pairs, strict=True))
        self.char = np.arange(0x110000, dtype=np.int64) + _CHAR
        for s, (i, _) in normal.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        self.char[ord(" ")] = self.char[ord(MARK)]
        self.most = most_units
        self._clear()

    def _clear(self):
        self.units, self.unit_ids = _Seen(), Rows()

    def _new_units(self):
        new = self.units.new
        if not new:
            return
        code = np.frombuffer("".join(new).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(new)), [len(u) for u in new])
        sym, of = merge_words(self.char[code], word, self.table)
        odd = np.flatnonzero(sym >= _CHAR)
        if len(odd):
            times = np.ones(len(sym), np.int64)
            raw = [chr(c).encode() for c in sym[odd] - _CHAR]
            times[odd] = [len(r) for r in raw]
            at = np.repeat(sym >= _CHAR, times)
            sym, of = np.repeat(sym, times), np.repeat(of, times)
            sym[at] = [self.byte[b] for r in raw for b in r]
        self.unit_ids.add(sym, np.bincount(of, minlength=len(new)))
        self.units.new = []

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (with the end)."""
        if len(self.units) > self.most:
            self._clear()
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), MARK, " ")
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        flat = np.ascontiguousarray(np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]])
        ends -= ends[0]
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        space = flat == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[ends[:-1][np.diff(ends) > 0]] = True
        at = np.flatnonzero(begins)
        units = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(flat)).astype(np.int32)), pa.py_buffer(flat))
        coded = pc.dictionary_encode(units)
        numbers = np.fromiter(map(self.units.__getitem__, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        self._new_units()
        ids, after = self.unit_ids.take(numbers[coded.indices.to_numpy()])
        return ids, after[np.searchsorted(at, ends)]

    def decode(self, ids: list[int]) -> str:
        if not ids:
            return ""
        if min(ids) >= self.plain_from:
            out = "".join(map(self.surface.__getitem__, ids))
            return out[1:] if out[0] == " " else out
        out, raw, seen = [], bytearray(), False

        def flush() -> None:
            while raw:
                for n in range(min(4, len(raw)), 0, -1):
                    try:
                        one = bytes(raw[:n]).decode()
                    except UnicodeDecodeError:
                        continue
                    if len(one) == 1:
                        out.append(one)
                        del raw[:n]
                        break
                else:
                    out.append("�")
                    del raw[:1]

        for i in ids:
            if i in self.value:
                raw.append(self.value[i])
                seen = True
                continue
            flush()
            s = "" if i in self.control else " ⁇ " if i == self.unknown else self.surface[i]
            if not seen and i != self.unknown and s.startswith(" "):
                s, seen = s[1:], True
            seen = seen or bool(s)
            out.append(s)
        flush()
        return "".join(out)


def encode_documents(docs: DataFrame, model_path: str, digests: bool = False) -> DataFrame:
    """doc_id and ids; or, with digests, doc_id, n_tokens, ids_sha256 and decoded_sha256, made from the ids in the same pass."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Pieces(model_path)
        for whole in batches:
            for b in slices(whole, "text"):
                flat, cut = codec.encode(b.column("text"))
                doc = b.column("doc_id")
                if not digests:
                    yield pa.RecordBatch.from_arrays([doc, pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat, pa.int32()))], ["doc_id", "ids"])
                    continue
                sha_ids, sha_text = [], []
                for k in range(b.num_rows):
                    ids = flat[cut[k] : cut[k + 1]].tolist()
                    sha_ids.append(hashlib.sha256(",".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest())
                    sha_text.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([doc, pa.array(np.diff(cut), pa.int64()), pa.array(sha_ids, pa.string()), pa.array(sha_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"doc_id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")
    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of encoded(doc_id, ids); null ids decode to the empty text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Pieces(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([codec.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), f"doc_id {kind}, text string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)
