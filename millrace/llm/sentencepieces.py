"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model file's protobuf is read by hand; normaliser, white-space marker, pieces with
their scores and byte fallback are rebuilt as a ``tokenizers`` pipeline, for unigram
and for BPE models. Texts are encoded in batches by the library's threads. Equality
with the original library is verified for every text, in the same pass.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

MARK = "▁"   # stands for a space
BATCH = 256       # texts encoded at a time
JOINED = 256      # words encoded as one text
REMEMBERED = 300_000   # words; beyond it they are forgotten
# Field numbers, kinds of pieces and of models in the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE, WORD, CHAR = 1, 2, 3, 4


@dataclass
class ModelFile:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)   # text, score, kind
    kind: int = UNIGRAM
    unknown: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_spaces: bool = True
    escape_spaces: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a protobuf message: integers, or raw bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value
    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at:at + size]
            at += size


def read_model(data: bytes) -> ModelFile:
    model = ModelFile()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            model.pieces.append((piece.get(1, b"").decode("utf-8"), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
            model.kind, model.unknown = trainer.get(3, UNIGRAM), trainer.get(40, 0)
            model.byte_fallback = bool(trainer.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.remove_spaces = bool(spec.get(3, 1)), bool(spec.get(4, 1))
            model.escape_spaces = bool(spec.get(5, 1))
    return model


def _merges(pieces: dict[str, tuple[int, float]]) -> list[tuple[str, str]]:
    """Every way to make a piece from two others, best piece first."""
    found = []
    for text, (number, score) in pieces.items():
        for cut in range(1, len(text)):
            left, right = text[:cut], text[cut:]
            if left in pieces and right in pieces:
                found.append((-score, number, pieces[left][0], pieces[right][0], left, right))
    return [f[4:] for f in sorted(found)]


def build(model: ModelFile):
    """The ``tokenizers`` pipeline of a model file."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = model.pieces[model.unknown][0]
    if model.kind == UNIGRAM:
        core = models.Unigram([(t, s) for t, s, _ in model.pieces], model.unknown, model.byte_fallback)
    elif model.kind == BPE:
        usable = {t: (i, s) for i, (t, s, k) in enumerate(model.pieces) if k in (NORMAL, USER)}
        core = models.BPE({t: i for i, (t, _, _) in enumerate(model.pieces)}, _merges(usable), unk_token=unknown,
                          fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    tokenizer = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.remove_spaces:
        steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Replace(Regex(r"\A | \z"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    # a mark inside a piece only follows other marks, so no piece crosses from a word
    # into the next mark: words are encoded apart, and the library remembers them
    if all(MARK not in t.lstrip(MARK) for t, _, k in model.pieces if k == NORMAL):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    after = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        after.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(after)
    return tokenizer


class Codec:
    """A model's pipeline with the ids of words remembered.

    Where no piece crosses from a word into the next mark and the normaliser changes
    nothing but spaces, the ids of a text with single spaces are those of its words, one
    after another. All other texts are encoded whole."""

    def __init__(self, data: bytes):
        model = read_model(data)
        self.tokenizer = build(model)
        self.by_word = (not model.charsmap and not model.remove_spaces and model.dummy_prefix
                        and model.escape_spaces
                        and all(MARK not in t.lstrip(MARK) for t, _, k in model.pieces if k == NORMAL))
        self.words: dict[str, tuple[bytes, bool]] = {}
        self.opens = np.array([t.startswith(MARK) for t, _, _ in model.pieces], dtype=bool)

    def _library(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        ids = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        back = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return [(array("i", i).tobytes(), t == b) for i, t, b in zip(ids, texts, back, strict=True)]

    def _words(self, words: list[str]) -> list[tuple[bytes, bool]]:
        """The same of words without spaces and marks. Many are encoded as one text, as a
        call costs more than a word; a piece that starts with a mark begins the next word.
        Where that does not give the words back, each is encoded by itself."""
        out = []
        parts = [words[at:at + JOINED] for at in range(0, len(words), JOINED)]
        texts = [" ".join(part) for part in parts]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        back = self.tokenizer.decode_batch(found, skip_special_tokens=False)
        for part, text, ids, decoded in zip(parts, texts, found, back, strict=True):
            ids = np.array(ids, dtype=np.int32)
            starts = np.flatnonzero(self.opens[ids])
            if decoded != text or len(starts) != len(part) or starts[0] != 0:
                out += self._library(part)
                continue
            raw, ends = ids.tobytes(), [*(4 * starts[1:]).tolist(), 4 * len(ids)]
            out += [(raw[a:b], True) for a, b in zip((4 * starts).tolist(), ends, strict=True)]
        return out

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """For each text its ids as 32-bit integers, and whether they decode to it."""
        split = [t.split(" ") if self.by_word and t and MARK not in t else None for t in texts]
        split = [w if w is not None and "" not in w else None for w in split]
        if len(self.words) > REMEMBERED:
            self.words = {}
        fresh = list({w for words in split if words for w in words if w not in self.words})
        self.words.update(zip(fresh, self._words(fresh), strict=True))
        whole = iter(self._library([t for t, words in zip(texts, split, strict=True) if words is None]))
        out = []
        for words in split:
            if words is None:
                out.append(next(whole))
            else:
                found = [self.words[w] for w in words]
                out.append((b"".join([f[0] for f in found]), all([f[1] for f in found])))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def _encode(model, threads):
    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        import sentencepiece
        codec, original = worker_cache(f"pieces {zlib.crc32(model.value)}", lambda: (
            Codec(model.value), sentencepiece.SentencePieceProcessor(model_proto=model.value)))
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.slice(at, BATCH)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, back = zip(*codec.encode(texts), strict=True)
                known = original.encode(texts, num_threads=threads)
                ends = np.cumsum([0, *[len(i) // 4 for i in ids]])
                values = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
                     pa.array([a == array("i", b).tobytes() for a, b in zip(ids, known, strict=True)], pa.bool_()),
                     pa.array(back, pa.bool_()), pa.array([zlib.crc32(i) for i in ids], pa.int64())],
                    ["doc_id", "ids", "parity", "round_trip", "ids_crc32"])
    return run


def encode(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text",
           threads: int = 1) -> DataFrame:
    """``(doc_id, ids, parity, round_trip, ids_crc32)``, one row per input row.

    ``parity``: the original library gives the same ids. It sums unigram scores in 32 bits,
    so between equally good splits ("a|aa", "aa|a") it may choose otherwise; the row says so. ``round_trip``: decoding gives
    the text back. A null or empty text has no ids. ``threads`` is the number of threads
    of a task, as many as the task has cores. The model file, read on the driver, has a
    fixed size. Texts of any length are encoded whole; other columns are not read.
    """
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(
        _encode(model, threads), f"doc_id {kind}, ids array<int>, parity boolean, round_trip boolean, ids_crc32 long")


def _decode(model):
    def run(batches):
        codec = worker_cache(f"decoder {zlib.crc32(model.value)}", lambda: Codec(model.value))
        for batch in batches:
            text = codec.decode([i or [] for i in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])
    return run


def decode(encoded: DataFrame, model_path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(doc_id, text)`` from ids, one row per input row; null ids give an empty text."""
    with open(model_path, "rb") as file:
        model = encoded.sparkSession.sparkContext.broadcast(file.read())
    own = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return own.mapInArrow(_decode(model), f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string")
