"""Packed id files: round trips at every width, random access, the query against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from deskpark.llm import bitpack as b
from deskpark.llm.common import work_dir
from deskpark.llm.queries import queries
from llm.cases import EDGE, SF_SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("width", range(1, 33))
def test_pack_and_unpack(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 64 * 5).astype(np.uint32)
    data = b.pack(ids, width)
    assert len(data) == 40 * width and np.array_equal(b.unpack(data, width), ids)


def test_width():
    assert [b.width_of(v) for v in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_file_and_random_access(tmp_path, monkeypatch):
    monkeypatch.setattr(b, "BLOCK", 128)
    rng = np.random.default_rng(1)
    docs = [(None, rng.integers(0, 5000, 3))] + [(k * 3, rng.integers(0, 5000, rng.integers(0, 400))) for k in range(50)]
    writer = b.Writer(f"file://{tmp_path}", "x.bpk", 13)
    for doc_id, ids in docs:
        writer.add(doc_id, ids.astype(np.uint32))
    whole = np.concatenate([d[1] for d in docs])
    assert writer.close() == (51, len(whole))
    reader = b.Reader(f"file://{tmp_path}/x.bpk")
    assert [(d, i.tolist()) for d, _, i in reader.documents(7)] == [(d, i.tolist()) for d, i in docs]
    for start, count in ((0, 1), (127, 2), (500, 900), (len(whole) - 1, 1), (5, 0)):
        assert np.array_equal(reader.read(start, count), whole[start: start + count])
    assert [p.name for p in tmp_path.iterdir()] == ["x.bpk"]


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\tab's.1é\xa0 "), st.characters(codec="utf-8")), max_size=50))
def test_encoding_by_words_is_exact(text):
    assert b_encoder().encode([text])[0].tolist() == plain(text)[:-1]


def b_encoder():
    return b._ENCODERS.setdefault(PATH, b.WordEncoder(PATH))


def expected(rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(plain(text), "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert got(queries()["op8_bit_packing"](spark, SF_SMALL)) == expected(docs)


def test_edge_rows_and_empty_table(spark, edge, empty):
    files = b.write(edge, PATH, 50257, work_dir(spark, "edge"))
    assert got(b.read(files)) == expected(EDGE)
    assert b.read(b.write(empty, PATH, 50257, work_dir(spark, "empty"))).count() == 0


LIBRARY = Tokenizer.from_file(PATH)
MARKED = ["a <|endoftext|> b", "a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> ", "a  <|endoftext|>\n<|endoftext|> <|endoftext|> b c", "<|endoftext|"]


def test_marker_in_a_text_is_encoded_as_the_library_does():
    """The contract is the library and the file, without any switch of ours."""
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in MARKED]
    assert want[0] == [64, 220, 50256, 275]
    assert [x.tolist() for x in b.WordEncoder(PATH).encode(MARKED)] == want
    one = b.WordEncoder(PATH)
    assert [one.encode([t])[0].tolist() for t in MARKED] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "a", "'s", "1", "\xa0", "<|", " b"]), max_size=12).map("".join))
def test_encoding_with_markers_is_exact(text):
    assert (b._ENCODERS.get(PATH) or b_encoder()).encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_a_hot_row_is_dealt_out_to_several_files(spark, make):
    rows = [(None, "without an id")] * 40 + [(7, "hot row")] * 400 + [(k, f"row {k}") for k in range(100)]
    files = b.write(make(rows).repartition(5), PATH, 50257, work_dir(spark, "hot"))
    assert files.agg({"n_docs": "max"}).first()[0] < 300 and got(b.read(files)) == expected(rows)


def remembered(encoder):
    return sum(len(x) for x in vars(encoder).values() if isinstance(x, dict))


def test_words_that_differ_in_their_signs_are_encoded_by_the_same_pieces():
    """40,000 distinct words of 400 pieces: the library is asked for the pieces."""
    one = b.WordEncoder(PATH)
    texts = [" ".join(f"{'abcdefghij'[k % 10] * (k // 10 + 1)}{'!#$%&*+,-/'[n % 10] * (n // 10 + 1)}" for k in range(200)) for n in range(200)]
    assert [x.tolist() for x in one.encode(texts)] == [plain(t)[:-1] for t in texts]
    assert remembered(one) < 1000


PARTS = ["'", "'s", "'re", "'LL", "’s", " ", "  ", "\n", "\r\n", "\xa0", " ", "\x1c", "\x85", "a", "Zé", "中", "Ⅷ", "²", "7", "_", "!", "́", "😀", "\xff", "<|endoftext|>"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=9).map("".join), max_size=6))
def test_many_texts_at_once_are_cut_as_the_library_cuts_each(texts):
    assert [x.tolist() for x in b_encoder().encode(texts)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgotten_and_long_pieces(monkeypatch):
    monkeypatch.setattr(b, "CACHE", 20)
    monkeypatch.setattr(b, "TOGETHER", 300)
    one = b.WordEncoder(PATH)
    texts = [f"word{k % 60} é{'x' * k}\n{k}. " for k in range(300)] * 2
    assert [x.tolist() for x in one.encode(texts)] == [plain(t)[:-1] for t in texts]
    assert all(len(p) <= b.LONG for p in one.known) and remembered(one) < 300
