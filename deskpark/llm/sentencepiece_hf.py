"""SentencePiece models run by the tokenizers library.

The model protobuf is parsed here, field by field; normaliser, meta-space marker, scores and byte
fallback are rebuilt as a tokenizers pipeline (Unigram or BPE, as the model says). Texts are cut at
runs of the marker, which no piece crosses, so that distinct words are encoded once, in multithreaded
batches, and kept in a bounded cache. Parity is verified for every word against the sentencepiece
library as it enters the cache: where the two differ (ties between equal scores), the ids of the
model's own library are taken and counted. A model with a piece that crosses a marker is
encoded and verified by whole texts.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskpark.llm.common import Generations, few_threads

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Distinct words in a generation of a worker's cache, texts whose new words are encoded together (and
#: returned together, so that no long batch of ids builds up), and new words joined to one line.
CACHE, TOGETHER, LINE = 60_000, 256, 64


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message; varints as int, the rest as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at: at + size], at + size
        yield key >> 3, value


@dataclass
class Spec:
    """What a model file says that encoding depends on."""

    pieces: list[tuple[str, float, int]]
    unigram: bool
    byte_fallback: bool
    unk_id: int
    charsmap: bytes
    dummy_prefix: bool
    single_spaces: bool


def parse(data: bytes) -> Spec:
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, b"\0" * 4))[0], f.get(3, _NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    kind = trainer.get(3, 1)
    if kind not in (1, 2):
        raise ValueError(f"model type {kind} is neither unigram nor BPE")
    unk = next((n for n, p in enumerate(pieces) if p[2] == _UNKNOWN), 0)
    return Spec(pieces, kind == 1, bool(trainer.get(35, 0)), unk, normalizer.get(2, b""),
                bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)))


def cuts(spec: Spec) -> bool:
    """Whether no piece crosses the start of a run of markers."""
    return not any(SPACE in p[0].lstrip(SPACE) for p in spec.pieces if p[2] in (_NORMAL, _USER))


def build(spec: Spec):
    """The model as a tokenizers pipeline for text whose spaces are markers already."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    def cut(model):
        made = Tokenizer(model)
        if cuts(spec):
            made.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"), "isolated")
        return made

    if spec.unigram:
        return cut(models.Unigram([p[:2] for p in spec.pieces], spec.unk_id, spec.byte_fallback))
    ids = {p[0]: n for n, p in enumerate(spec.pieces)}
    usable = {p[0]: p[1] for p in spec.pieces if p[2] in (_NORMAL, _USER)}
    merges = []
    for piece, score in usable.items():
        splits = [(piece[:k], piece[k:]) for k in range(1, len(piece))]
        merges += [(-score, ids[piece], a, b) for a, b in splits if a in usable and b in usable]
    merges = [(a, b) for _, _, a, b in sorted(merges, key=lambda m: m[:2])]
    unk = spec.pieces[spec.unk_id][0]
    return cut(models.BPE(ids, merges, unk_token=unk, fuse_unk=True, byte_fallback=spec.byte_fallback))


class Codec:
    """Encodes and decodes whole texts; ``repaired`` counts words whose ids were taken from the model's own library."""

    def __init__(self, path: str):
        import sentencepiece
        from tokenizers import normalizers

        few_threads()
        with open(path, "rb") as f:
            data = f.read()
        self.spec = spec = parse(data)
        self.backend = build(spec)
        self.own = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.charsmap = normalizers.Precompiled(spec.charsmap) if spec.charsmap else None
        self.cuts = cuts(spec)
        self.opens = np.array([p[0].startswith(SPACE) for p in spec.pieces])
        self.words = Generations(CACHE)
        self.repaired = 0
        self.bytes = [
            bytes([int(p[3:5], 16)]) if kind == _BYTE else b"" if kind == _CONTROL else " ⁇ ".encode() if kind == _UNKNOWN
            else p.replace(SPACE, " ").encode() for p, _, kind in spec.pieces]

    def normalized(self, text: str) -> str:
        """The text as the model sees it, spaces as markers."""
        if self.charsmap is not None:
            text = self.charsmap.normalize_str(text)
        if self.spec.single_spaces:
            text = re.sub(" +", " ", text.replace(SPACE, " ")).strip(" ")
        if not text:
            return ""
        return (" " * self.spec.dummy_prefix + text).replace(" ", SPACE)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self._cut(self.normalized(t or "")) for t in texts]
        self._learn(self.words.unknown({w for c in cut for w in c}))
        return [np.frombuffer(b"".join(map(self.words.__getitem__, c)), "<i4") for c in cut]

    def _cut(self, text: str) -> list[str]:
        return _CHUNK.findall(text) if self.cuts else [text] * bool(text)

    def _learn(self, words: list[str]) -> None:
        """Encodes new words with both libraries: plain ones by lines of many, the others one by one."""
        plain = [w for w in words if len(w) > 1 and w.rfind(SPACE) == 0] if self.cuts and self.spec.dummy_prefix else []
        odd = list(set(words).difference(plain))
        lines = [plain[at: at + LINE] for at in range(0, len(plain), LINE)]
        texts = ["".join(line) for line in lines]
        mine = [e.ids for e in self.backend.encode_batch_fast(texts, add_special_tokens=False)]
        theirs = self.own.encode([t[1:].replace(SPACE, " ") for t in texts], num_threads=1)
        for line, a, b in zip(lines, mine, theirs):
            ids = np.array(a, "<i4")
            starts = np.flatnonzero(self.opens[ids])
            if a != b or len(starts) != len(line):
                odd += line
                continue
            data, bounds = ids.tobytes(), (4 * np.append(starts, len(ids))).tolist()
            self.words.update(zip(line, (data[x:y] for x, y in zip(bounds, bounds[1:]))))
        mine = [e.ids for e in self.backend.encode_batch_fast(odd, add_special_tokens=False)]
        alone = [(w[1:] if self.spec.dummy_prefix and w[0] == SPACE else w).replace(SPACE, " ") for w in odd]
        for word, a, b in zip(odd, mine, self.own.encode(alone, num_threads=1)):
            if a != b and self._verifiable(word):
                self.repaired += 1
                a = b
            self.words[word] = struct.pack(f"<{len(a)}i", *a)

    def _verifiable(self, word: str) -> bool:
        """Whether the model's own library, which adds its prefix to what it is given, sees this very word."""
        return not self.spec.dummy_prefix or word[0] == SPACE != word

    def decode(self, ids) -> str:
        """The text of the ids: pieces joined, bytes of fallback read as UTF-8, the added prefix taken off."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.spec.dummy_prefix and text[:1] == " " else text


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a model file, with its cache of words."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_column(text: Column, path: str) -> Column:
    """struct(ids, decoded_equal): ids of the whole text (none for null or empty), and whether decoding gives it back.

    ``path`` is read by each executor. decoded_equal compares with the normalised text, which is the text
    itself for a model whose normaliser changes nothing.
    """

    @F.pandas_udf("ids array<int>, decoded_equal boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                texts = [t or "" for t in batch.iloc[at: at + TOGETHER]]
                ids, same = own.encode(texts), []
                for text, i in zip(texts, ids):
                    seen = own.normalized(text).replace(SPACE, " ")
                    same.append(own.decode(i) == (seen[1:] if own.spec.dummy_prefix else seen))
                yield pd.DataFrame({"ids": ids, "decoded_equal": same})

    return of(text)


def decode_column(ids: Column, path: str) -> Column:
    """The text of an array of ids; null for null."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path)
        for batch in batches:
            yield pd.Series([None if i is None else own.decode(i) for i in batch], dtype=object)

    return of(ids)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_tokens, ids, decoded_equal): one row for each input row, other columns are not read."""
    out = docs.select("doc_id", encode_column(F.col("text"), path).alias("e"))
    return out.select("doc_id", F.size("e.ids").cast("long").alias("n_tokens"), F.col("e.ids").alias("ids"),
                      F.col("e.decoded_equal").alias("decoded_equal"))
