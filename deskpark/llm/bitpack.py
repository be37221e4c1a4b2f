"""Token ids in files of fixed-width packed bits.

File: ``BPK1``, then blocks of ``BLOCK`` ids, each id in the fewest bits that hold the vocabulary,
little-endian bit order, the last block filled up with zero ids; then the footer: block offsets
(unsigned 64-bit), for each document whether it has an id (8-bit), its id (64-bit) and its first
position in the file (unsigned 64-bit), and last the six numbers of ``_TAIL``. Any range of ids is read
by seeking to its blocks and unpacked by vectorised shifts, 64 ids to ``width`` words at a time.

Texts are encoded where they lie, their ids are range-partitioned by doc_id and sorted, and each task streams its
documents into one file: it is written under another name and renamed when it is whole, and a repeated task writes the same
bytes, so a lost executor costs a task. The folder may be on any file system that pyarrow opens by URI.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskpark.llm.common import Generations

MAGIC = b"BPK1"
BLOCK = 1 << 16
_TAIL = struct.Struct("<QQQQII")  # ids, documents, blocks, place of the footer, width, ids of a block
#: Rows whose keys are collected to cut the files.
SAMPLE = 20_000
#: Distinct pieces of each of the two generations that a worker remembers, characters of texts that are encoded
#: together, and bytes of the longest piece that is remembered.
CACHE, TOGETHER, LONG = 600_000, 4_000_000, 200
#: Classes of characters besides 1 to 3 (letters, numbers, other signs): white space, and the end of a text.
_WHITE, _END = 4, 5


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids (a multiple of 64 of them) in ``width`` bits each."""
    columns = ids.astype(np.uint64).reshape(-1, 64).T
    words = np.zeros((width + 1, columns.shape[1]), np.uint64)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        words[word] |= columns[k] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= columns[k] >> np.uint64(64 - shift)
    return words[:width].T.astype("<u8").tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    """The ids of whole groups of 64, as unsigned 32-bit integers."""
    words = np.frombuffer(data, "<u8").reshape(-1, width).T
    out, mask = np.empty((64, words.shape[1]), np.uint32), np.uint64((1 << width) - 1)
    for k in range(64):
        word, shift = divmod(k * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[word + 1] << np.uint64(64 - shift)
        out[k] = value & mask
    return out.T.ravel()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """Streams documents into one file; ``close`` gives (documents, ids) and makes the file visible."""

    def __init__(self, folder: str, name: str, width: int):
        self.fs, self.path = _filesystem(f"{folder}/{name}")
        self.hidden, self.width = f"{self.path}.{uuid.uuid4().hex}", width
        self.out = self.fs.open_output_stream(self.hidden)
        self.out.write(MAGIC)
        self.rest, self.held, self.offsets, self.at = [], 0, [], len(MAGIC)
        self.named, self.keys, self.firsts, self.ids = [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.named.append(doc_id is not None)
        self.keys.append(doc_id or 0)
        self.firsts.append(self.ids)
        self.ids += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.rest)
        for at in range(0, count, BLOCK):
            data = pack(ids[at: at + BLOCK], self.width)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.rest = [ids[count:]]
        self.held = len(ids) - count

    def close(self) -> tuple[int, int]:
        if self.held:
            self.rest.append(np.zeros(-self.held % BLOCK, np.uint32))
            self.held += -self.held % BLOCK
            self._flush(self.held)
        for values, kind in ((self.offsets, "<u8"), (self.named, "u1"), (self.keys, "<i8"), (self.firsts, "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(_TAIL.pack(self.ids, len(self.keys), len(self.offsets), self.at, self.width, BLOCK))
        self.out.close()
        self.fs.move(self.hidden, self.path)
        return len(self.keys), self.ids


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str):
        self.fs, path = _filesystem(uri)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - _TAIL.size)
        self.n_ids, docs, blocks, at, self.width, self.block = _TAIL.unpack(self.file.read(_TAIL.size))
        self.file.seek(at)
        data = self.file.read(size - _TAIL.size - at)
        cut = np.cumsum([0, 8 * blocks, docs, 8 * docs, 8 * docs])
        self.offsets, named, keys, self.firsts = (
            np.frombuffer(data[a:b], kind) for a, b, kind in zip(cut, cut[1:], ("<u8", "u1", "<i8", "<u8")))
        self.doc_ids = [int(k) if n else None for n, k in zip(named, keys)]

    def read(self, start: int, count: int) -> np.ndarray:
        """Ids start to start + count, of which only the blocks that hold them are read."""
        first, last = start // self.block, -(-(start + count) // self.block)
        if count <= 0:
            return np.zeros(0, np.uint32)
        bytes_of = self.block * self.width // 8
        self.file.seek(int(self.offsets[first]))
        ids = unpack(self.file.read((last - first) * bytes_of), self.width)
        return ids[start - first * self.block:][:count]

    def documents(self, together: int = 64) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first position in the file, ids), a run of documents read at a time."""
        ends = np.append(self.firsts[1:], self.n_ids).astype(np.int64)
        for at in range(0, len(self.doc_ids), together):
            own = range(at, min(at + together, len(self.doc_ids)))
            low = int(self.firsts[at])
            ids = self.read(low, int(ends[own[-1]]) - low)
            for n in own:
                yield self.doc_ids[n], int(self.firsts[n]), ids[int(self.firsts[n]) - low: int(ends[n]) - low]

    def close(self) -> None:
        self.file.close()


class Remembered(Generations):
    """Generations that are asked for many words at once."""

    def get_all(self, words: list) -> list:
        """The values of words, None for those in neither generation; all others are in the young one afterwards."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
        found = list(map(self.get, words))
        if self.old:
            for n, value in enumerate(found):
                if value is None and (value := self.old.get(words[n])) is not None:
                    found[n] = self[words[n]] = value
        return found


class WordEncoder:
    """Encodes by distinct pieces; exact for a byte-level tokenizer that cuts text by the usual pattern.

    That is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``: many texts are cut at
    once by the classes of their characters, each asked of the library when it is first met, the library
    encodes each distinct piece, and a text's ids are those of its pieces, one after the other. The library takes
    added tokens such as <|endoftext|> out before it cuts, and so does this class; they must be plain (no stripping).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.backend = Tokenizer.from_file(path)
        self.marks = {t.content: np.array([n], "<u4") for n, t in self.backend.get_added_tokens_decoder().items()}
        self.mark = re.compile("(" + "|".join(map(re.escape, sorted(self.marks, key=len, reverse=True))) + ")")
        self.classes, self.known = np.zeros(0x110000, np.uint8), Remembered(CACHE)
        # The sign by which the model knows each byte, asked of the library by characters that hold every byte of UTF-8.
        signs = "".join(map(chr, [*range(0x800), *range(0x800, 0xD000, 0x800), 0xD000, 0xE000, 0xF000, *range(0x10000, 0x110000, 0x10000)]))
        self.letters = np.full(256, ord("\n"), "<u2")  # 255 is in no text, and a line feed is no sign
        self.letters[list(signs.encode())] = [ord(x) for piece, _ in self.backend.pre_tokenizer.pre_tokenize_str(signs) for x in piece]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        marked = {n: self.mark.split(t) for n, t in enumerate(texts) if any(m in t for m in self.marks)}
        if marked:  # every second part is a mark
            parts = iter(self.encode([x for n, t in enumerate(texts) for x in (marked[n][::2] if n in marked else [t])]))
            return [np.concatenate([self.marks[x] if k % 2 else next(parts) for k, x in enumerate(marked[n])]) if n in marked else next(parts)
                    for n in range(len(texts))]
        out, at, sizes = [], 0, np.cumsum([len(t) for t in texts])
        while at < len(texts):  # so many texts at a time that their pieces fit into memory
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER, "right")))
            out += self._encode(texts[at:end])
            at = end
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        joined = "\n".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = np.flatnonzero(self._cuts(points, ends))
        firsts = np.searchsorted(starts, ends)  # the pieces that stand for the ends of texts
        data = joined.encode()
        places = starts if len(data) == len(points) else np.flatnonzero(np.frombuffer(data, np.int8) >= -64)[starts]  # bytes that begin a character
        pieces = _binary(np.append(places, len(data)), data).dictionary_encode()
        bounds, values = _taken(self._learn(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pieces.indices)
        lows = bounds[np.append(0, firsts[:-1] + 1)]
        return [values[a // 4: b // 4] for a, b in zip(lows.tolist(), bounds[firsts].tolist())]

    def _cuts(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether a piece begins at each code point; each of ``ends``, the places after texts, is a piece."""
        kinds = self.classes[points]
        if not kinds.all():
            self._classify(np.unique(points[kinds == 0]))
            kinds = self.classes[points]
        kinds[ends] = _END
        space, white = points == 0x20, kinds == _WHITE
        cut = np.ones(len(points) + 3, bool)
        # A new piece begins where the class changes, but a space belongs to what follows it ...
        np.not_equal(kinds[1:], kinds[:-1], out=cut[1: len(points)])
        cut[1: len(points)] &= ~space[:-1]
        # ... and so does the last character of a run of white space that is followed by something.
        cut[1: len(points) - 1] |= white[1:-1] & white[:-2] & (kinds[2:] < _WHITE)
        cut[ends] = cut[ends + 1] = True
        # An apostrophe that begins a piece takes s, t, m, d, re, ve or ll with it.
        at = np.flatnonzero((points == 0x27) & cut[: len(points)])
        after, then = points[at + 1], points[np.minimum(at + 2, len(points) - 1)]
        short = np.isin(after, [ord(x) for x in "stmd"])
        long = (np.isin(after, [ord(x) for x in "rv"]) & (then == ord("e"))) | ((after == ord("l")) & (then == ord("l")))
        cut[at[short | long] + 1] = False
        cut[at[short] + 2] = cut[at[long] + 3] = True
        return cut[: len(points)]

    def _classify(self, points: np.ndarray) -> None:
        """Asks the library which of letters, numbers and other signs, if any, a character goes on with."""
        cut = self.backend.pre_tokenizer.pre_tokenize_str
        for c in map(chr, points.tolist()):
            self.classes[ord(c)] = next((k for k, x in enumerate("a1!", 1) if len(cut(x + c)) == 1), _WHITE)

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces; the library's model encodes those that are not remembered."""
        found = self.known.get_all(pieces)
        new = [n for n, ids in enumerate(found) if ids is None]
        tokenize, ids, ends = self.backend.model.tokenize, [], []
        spelt = self.letters[np.frombuffer(b"\xff".join([pieces[n] for n in new]), np.uint8)].tobytes().decode("utf-16-le")
        for piece in spelt.split("\n") if new else []:
            ids += [x.id for x in tokenize(piece)]
            ends.append(4 * len(ids))
        data = np.array(ids, "<u4").tobytes()
        for n, low, high in zip(new, [0, *ends], ends):
            found[n] = data[low:high]
        self.known.update([(pieces[n], found[n]) for n in new if len(pieces[n]) <= LONG])
        return found


def _binary(bounds: np.ndarray, data: bytes):
    """An Arrow array of the parts of ``data`` between ``bounds``."""
    import pyarrow as pa

    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)])


def _taken(values: list[bytes], indices) -> tuple[np.ndarray, np.ndarray]:
    """``values`` at ``indices``, one after the other: where each begins and, last, the end (in bytes); all their ids."""
    import pyarrow as pa

    taken = pa.array(values, pa.large_binary()).take(indices)
    _, bounds, data = taken.buffers()
    return np.frombuffer(bounds, np.int64)[: len(taken) + 1], np.frombuffer(data or b"", "<u4")


_ENCODERS: dict[str, WordEncoder] = {}


def _bounds(docs: DataFrame, parts: int) -> list[tuple]:
    """Keys (doc_id known, doc_id, text hash) that cut the rows into ``parts`` ranges of about equal size; a hot key occurs several times.

    They are taken from at most about ``SAMPLE`` rows, chosen by hash; which rows are taken changes the sizes of the files alone.
    """
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"))
    step = max(1, keys.count() // SAMPLE)
    # Equal rows have equal hashes, and are taken or left together: they are numbered, so that a share of them is taken.
    some = keys.withColumn("mark", F.monotonically_increasing_id()).where(F.pmod(F.xxhash64("doc_id", "tie", "mark"), F.lit(step)) == 0)
    found = sorted((r.doc_id is not None, r.doc_id or 0, r.tie) for r in some.select("doc_id", "tie").collect())
    return [found[len(found) * k // parts] for k in range(1, parts)] if found else []


def write(docs: DataFrame, tokenizer: str, vocabulary: int, folder: str, end_id: int = 0) -> DataFrame:
    """Encodes (doc_id, text, ...) and writes the files; returns (file, part, n_docs, n_ids), one row for each file.

    Files follow each other in ascending doc_id (null ids first, the order of repeated ones is that of a hash of
    their text), each document ends with ``end_id``, and a null or empty text is that one id; texts of any
    length are encoded whole. An empty table writes no file; other columns are not read. Texts are
    encoded where they lie and only their ids are shuffled, each to the file whose range holds its key; rows of
    one key that fills several ranges are dealt out to all of them. The rows returned are those of a table written in ``folder``.
    """
    width, kind = width_of(vocabulary), "<u2" if vocabulary <= 1 << 16 else "<u4"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(docs, parts)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from bisect import bisect_left, bisect_right

        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = WordEncoder(tokenizer)
        end, n = np.array([end_id], kind).tobytes(), 0
        for batch in batches:
            encoded = _ENCODERS[tokenizer].encode([t or "" for t in batch.text])
            keys = [(not pd.isna(i), 0 if pd.isna(i) else int(i), int(tie)) for i, tie in zip(batch.doc_id, batch.tie)]
            part = []
            for key in keys:
                low, high = bisect_left(bounds, key), bisect_right(bounds, key)
                part.append(high if high - low < 2 else low + 1 + n % (high - low))
                n += 1
            yield pd.DataFrame({"part": np.array(part, np.int32), "doc_id": batch.doc_id, "tie": batch.tie, "ids": [e.astype(kind).tobytes() + end for e in encoded]})

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            writer = writer or Writer(folder, f"part-{part:06d}.bpk", width)
            for doc_id, ids in zip(batch.doc_id, batch.ids):
                writer.add(None if pd.isna(doc_id) else int(doc_id), np.frombuffer(ids, kind).astype(np.uint32))
        if writer:
            n_docs, n_ids = writer.close()
            yield pd.DataFrame({"file": [f"{folder}/part-{part:06d}.bpk"], "part": [part], "n_docs": [n_docs], "n_ids": [n_ids]})

    _create(folder)
    # An id must stay exact on its way through pandas, which has no null integers: it travels as text.
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.xxhash64("text").cast("string").alias("tie"), "text")
    encoded = rows.mapInPandas(encode, "part int, doc_id string, tie string, ids binary")
    ordered = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("doc_id").cast("long"), F.col("tie").cast("long"))
    ordered.select("doc_id", "ids").mapInPandas(task, "file string, part int, n_docs long, n_ids long").write.parquet(f"{folder}/files.parquet")
    return docs.sparkSession.read.parquet(f"{folder}/files.parquet")


def _create(folder: str) -> None:
    system, path = _filesystem(folder)
    system.create_dir(path, recursive=True)


def read(files: DataFrame) -> DataFrame:
    """(file, part, n_ids) -> (doc_id, start, n_tokens, ids_crc32) of each document, read from the files.

    start counts the ids of all documents before; the crc is that of the ids as little-endian unsigned
    32-bit integers.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, before in zip(batch.file, batch.before):
                reader, rows = Reader(file), []
                for doc_id, at, ids in reader.documents():
                    rows.append((doc_id, before + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) >= 10_000:
                        yield _frame(rows)
                        rows = []
                reader.close()
                yield _frame(rows)

    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    placed = files.withColumn("before", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    spread = placed.select("file", "before").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    out = spread.mapInPandas(task, "doc_id string, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return frame.assign(doc_id=[None if r[0] is None else str(r[0]) for r in rows])
