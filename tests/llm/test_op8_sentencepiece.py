import random

import numpy as np
import pytest
import sentencepiece

from loomtext.llm.queries import tokenizer_path
from loomtext.llm.sentencepiece_codec import CharacterMap, PieceCodec, encode_documents, wire_fields

PATH = tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "▁", "a▁ b", " ▁ ▁", "\n", "\n\n a", "x\ty", "漢字 😀 z", "<s> <0x41> </s>", "é" * 60, "ab" * 500, "a" + " " * 40 + "b", " x　y", "\0a", "á é"]


@pytest.fixture(scope="module")
def pair():
    with open(PATH, "rb") as file:
        data = file.read()
    return PieceCodec(data), sentencepiece.SentencePieceProcessor(model_proto=data)


def test_same_as_the_library(pair):
    own, library = pair
    draw = random.Random(7)
    texts = ODD + ["".join(draw.choice("ab the▁ \n😀éñ.,x") for _ in range(draw.randint(1, 120))) for _ in range(600)]
    for text in texts:
        want = library.encode(text)
        for got in (own.encode(text), own._encode_whole(text) if text else own.encode(text)):
            assert got.ids.tolist() == want
            assert got.decoded == library.decode(want) == own.decode(want)
            assert got.id_text == ",".join(map(str, want))
            if text:
                assert got.begins[0] == 0 and got.ends[-1] == len(text.encode())
                assert (got.begins[1:] == got.ends[:-1]).all()


def test_spans_are_the_pieces_text(pair):
    own, _ = pair
    text = "Das ist größer.\n\n  Ja"
    got = own.encode(text)
    data = text.encode()
    parts = [data[b:e] for b, e in zip(got.begins, got.ends)]
    assert b"".join(parts) == data
    whole = own._encode_whole(text)
    assert np.array_equal(whole.begins, got.begins) and np.array_equal(whole.ends, got.ends)


def test_compiled_map_takes_the_longest_prefix_and_keeps_places():
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf")
    spec = next(v for n, v in wire_fields(normalizer.serialized_model_proto()) if n == 3)
    table = CharacterMap(dict(wire_fields(spec))[2])
    assert table.longest("Ｋ".encode(), 0) == (3, b"k")
    assert table.longest("ﬃx".encode(), 0) == (3, b"ffi")
    assert table.longest(b"q", 0) is None or table.longest(b"q", 0) == (1, b"q")
    own = PieceCodec.__new__(PieceCodec)
    own.map, own.prefix, own.squeeze, own.escape = table, True, True, True
    for text in ("ＡＢＣ ﬃ ①", "Ｋﾞ é ½", "ABC"):
        data, place = own.normalise(text)
        want = normalizer.normalize(text)
        assert data.decode().strip() == want.strip()
        assert len(place) == len(data) + 1 and place == sorted(place) and place[-1] == len(text.encode())


def message(number, value):
    """A protocol buffer field: an integer or bytes."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "nfkc"])
@pytest.mark.parametrize("squeeze", [0, 1])
def test_same_as_the_library_with_a_compiled_map(pair, rule, squeeze):
    """The model's pieces with another normaliser: ids, decoding and offsets through the map's alignment."""
    spec = next(v for n, v in wire_fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()) if n == 3)
    blob = dict(wire_fields(spec))[2]
    with open(PATH, "rb") as file:
        parts = [(n, v) for n, v in wire_fields(file.read()) if n != 3]
    model = b"".join(message(n, v) for n, v in parts) + message(3, message(1, rule.encode()) + message(2, blob) + message(3, 1) + message(4, squeeze) + message(5, 1))
    own, library = PieceCodec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    assert own.by_word == (not squeeze)
    draw = random.Random(5)
    texts = ODD + ["ＡＢＣ ﬃ ①", "Ｋﾞ é ½ a", "x\u3000\u3000y  z ", "…Straße ǅ"] + ["".join(draw.choice("abA \u3000ﬁé①Ｋ\n.") for _ in range(draw.randint(1, 60))) for _ in range(300)]
    for text in texts:
        got = own.encode(text)
        if not text:
            continue
        assert got.ids.tolist() == library.encode(text), text
        assert got.decoded == library.decode(got.ids.tolist())
        data, place = own.aligned(text)
        assert len(place) == len(data) + 1 and (np.diff(place) >= 0).all()
        if len(got.ids):
            assert (got.begins[1:] == got.ends[:-1]).all() and got.ends[-1] <= len(text.encode())


def test_offsets_come_from_the_recorded_alignment(pair):
    """Over the whole of a table: every piece's source bytes, normalised again, are the piece."""
    own, _ = pair
    import pyarrow.parquet as pq

    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist() + ODD:
        if not text:
            continue
        got, data = own.encode(text), text.encode()
        whole = own._encode_whole(text)
        assert np.array_equal(whole.begins, got.begins) and np.array_equal(whole.ends, got.ends) and np.array_equal(whole.ids, got.ids)
        for k, (number, b, e) in enumerate(zip(got.ids.tolist(), got.begins.tolist(), got.ends.tolist(), strict=True)):
            said = bytes([own.byte_of[number]]) if number in own.byte_of else own.pieces[number].encode()
            source = (b" " if k == 0 else b"") + data[b:e]
            if "▁" not in text:
                assert source.replace(b" ", "▁".encode()) == said or number in own.byte_of


def test_rows_nulls_repeats_and_clashing_names(spark, pair):
    rows = [(1, "Hello world", 5), (1, "Hello world", 6), (None, "", 7), (3, None, 8), (4, "x" * 50000 + " y", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = encode_documents(df, PATH).collect()
    assert len(got) == 5
    for row in got:
        text = next(r[1] for r in rows if r[0] == row.doc_id) or ""
        assert list(row.ids) == pair[1].encode(text)
        assert row.decoded == text
    assert encode_documents(df.limit(0), PATH).count() == 0
