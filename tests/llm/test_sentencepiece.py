"""SentencePiece by the tokenizers library: parity with the model's own library, round trips, both model types."""

import struct

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from deskpark.llm import sentencepiece_hf as s
from deskpark.llm.queries import PIECES, queries
from llm.cases import EDGE, LONG, SF_SMALL

PATH = public_tokenizers.path(PIECES)
CODEC = s.Codec(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\tab.é▁aaa"), st.characters(codec="utf-8")), max_size=60))
def test_parity_of_any_text(text):
    ids = CODEC.encode([text])[0].tolist()
    assert ids == CODEC.own.encode(text)
    assert CODEC.decode(ids) == CODEC.own.decode(ids)


def test_long_and_special_texts():
    texts = [LONG, "x" * 9000, "<s> </s> <unk> <0x41>", " lead", "trail ", "a  b   c", "a" * 31 + " " + "a" * 17]
    assert [x.tolist() for x in CODEC.encode(texts)] == [CODEC.own.encode(t) for t in texts]


def field(number, kind, value):
    key = bytes([number << 3 & 127 | 128, number >> 4]) if number > 15 else bytes([number << 3 | kind])
    if number > 15:
        key = bytes([(number << 3 | kind) & 127 | 128, (number << 3 | kind) >> 7])
    return key + value


def message(data):
    size, n = b"", len(data)
    while n > 127:
        size, n = size + bytes([n & 127 | 128]), n >> 7
    return size + bytes([n]) + data


def unigram_model(single_spaces):
    """A unigram model file, written by hand."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", -30.0, 6) for b in range(256)]
    pieces += [("▁", -4.0, 1), *[(c, -6.0 - k / 9, 1) for k, c in enumerate("abcdehlort")]]
    pieces += [("▁the", -2.5, 1), ("▁a", -3.1, 1), ("bcd", -5.2, 1), ("cde", -5.3, 1), ("▁hat", -4.4, 1), ("at", -4.1, 1)]
    out = b""
    for piece, score, kind in pieces:
        body = field(1, 2, message(piece.encode())) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        out += field(1, 2, message(body))
    trainer = field(3, 0, b"\x01") + field(35, 0, b"\x01")
    normalizer = field(1, 2, message(b"identity")) + field(3, 0, b"\x01") + field(4, 0, bytes([single_spaces])) + field(5, 0, b"\x01")
    return out + field(2, 2, message(trainer)) + field(3, 2, message(normalizer))


@pytest.mark.parametrize("single_spaces", [False, True])
def test_unigram_model(tmp_path, single_spaces):
    path = tmp_path / "unigram.model"
    path.write_bytes(unigram_model(single_spaces))
    codec = s.Codec(str(path))
    assert codec.spec.unigram and codec.spec.byte_fallback
    texts = ["the hat", "a bcde  the", "  that hat ", "zé hat", "", "abcdeabcde"]
    own = sentencepiece.SentencePieceProcessor(model_file=str(path))
    assert [x.tolist() for x in codec.encode(texts)] == [own.encode(t) for t in texts]


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = queries()["op4_sentencepiece"](spark, SF_SMALL).collect()
    assert {r.doc_id: r.ids for r in got} == {d: CODEC.own.encode(t) for d, t in docs.items()}
    assert all(r.decoded_equal and r.n_tokens == len(r.ids) for r in got)


def test_edge_rows_and_empty_table(edge, empty):
    got = s.encode(edge, PATH)
    rows = sorted((r.doc_id or -1, r.ids) for r in got.collect())
    assert rows == sorted((d or -1, CODEC.own.encode(t or "")) for d, t in EDGE)
    back = got.select("doc_id", s.decode_column(got.ids, PATH).alias("t"))
    # The marker itself is read back as a space: the model cannot tell them apart.
    assert sorted((r.doc_id or -1, r.t) for r in back.collect()) == sorted((d or -1, (t or "").replace("▁", " ")) for d, t in EDGE)
    assert s.encode(empty, PATH).count() == 0
