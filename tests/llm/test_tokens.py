"""BPE helper, chunk reuse and packing: exact against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearth.llm import bpe, packing
from hearth.llm.tokens import ByteBpe
from tests.conftest import SF_SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a b ", "\n\n x\t y  ", "a<|endoftext|> b <|endoftext|>  <|endoftext|>\n", "x \x1c y\x85 z", "a ",
       "don't we'll  's", "1 2 3\r\n 4", "日本 語 😀 é é", "a" * 3000, " " * 2500, "ab " * 4000]


@pytest.fixture(scope="module")
def tok():
    return ByteBpe(PATH)


@given(st.text(alphabet=list(" \n\t\r\x0b\x1c\x85  　ab'sé1²Ⅷ日.!,<|>_"), max_size=30))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_library(text):
    tok = ByteBpe.of(PATH)
    assert tok.ids(text) == tok.raw(text)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_and_decoding(tok, text):
    assert tok.ids(text) == tok.raw(text)
    ids = np.frombuffer(tok.ids(text), "<u4")
    assert tok.text(ids) == tok.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


@given(st.lists(st.text(alphabet=list(" \nab'é1日.<|>"), max_size=12), max_size=8))
@settings(max_examples=300, deadline=None)
def test_joins_are_repaired_exactly(parts):
    tok = ByteBpe.of(PATH)
    runs = [bpe.Encoded.of(p, tok) for p in parts]
    assert bpe.joined(((e.head, e.ids, e.tail, e.cut) for e in runs), tok) == tok.raw("".join(parts))


def test_a_special_token_across_a_join(tok):
    runs = [bpe.Encoded.of(p, tok) for p in ("x y <|endo", "ftext|> z w")]
    assert bpe.joined(((e.head, e.ids, e.tail, e.cut) for e in runs), tok) == tok.raw("x y <|endoftext|> z w")


def test_chunks_cover_the_text_and_follow_content():
    table = bpe._mixed(256)
    rng = np.random.default_rng(1)
    body = "".join(chr(c) for c in rng.integers(97, 123, 20_000)) + "日本" * 500
    data = body.encode()
    parts = bpe.chunks(data, table)
    assert b"".join(parts) == data and all(p.decode() for p in parts)
    assert max(map(len, parts)) <= bpe.GREATEST + 3 and len(parts) > 10
    moved = bpe.chunks(b"another beginning " + data, table)
    assert len(set(parts) & set(moved)) >= len(parts) - 3


def _encoded(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, key string")
    return sorted(((r.doc_id, bytes(r.ids)) for r in bpe.encode(docs, PATH).collect()), key=repr)


def test_encode_equals_the_library_with_shared_chunks(spark, tok):
    texts = [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect()]
    shared = texts[0] + "\n" + texts[1]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, shared), (901, "new start. " + shared), (902, shared)]
    rows += [(903 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (5, None), (5, None), (0, texts[0])]
    rows = [(*r, "clash", "clash") for r in rows]
    expected = sorted(((i, tok.raw(t or "")) for i, t, *_ in rows), key=repr)
    assert _encoded(spark, rows) == expected


def test_encode_empty_table(spark):
    assert _encoded(spark, []) == []


def test_decode_column(spark, tok):
    rows = [(bytearray(tok.raw("a é 日")), "a é 日"), (None, None), (bytearray(b""), "")]
    df = spark.createDataFrame(rows, "ids binary, t string")
    assert df.where(~bpe.decode(F.col("ids"), PATH).eqNullSafe(F.col("t"))).count() == 0


@given(st.integers(1, 5000))
def test_pieces_of_a_document(n):
    pieces = packing.pieces_of(n)
    assert [s for s, _ in pieces] == list(np.cumsum([0, *[length for _, length in pieces[:-1]]]))
    assert sum(length for _, length in pieces) == n and all(length == 1024 for _, length in pieces[1:])


@given(st.lists(st.integers(1, 1023), max_size=200), st.integers(1, 20))
@settings(deadline=None)
def test_best_fit_against_a_plain_version(lengths, open_bins):
    fit, plain, bins = packing.BestFit(open_bins), [], 0
    for x in lengths:
        number, offset = fit.put(x)
        holds = [b for b in plain if b[1] + x <= 1024]
        if holds:
            best = max(holds, key=lambda b: b[1])
            own = next(b for b in plain if b[0] == number)
            assert own[1] == best[1] == offset
        else:
            if len(plain) == open_bins:
                full = max(b[1] for b in plain)
                gone = fit.open_numbers() | {number}
                plain.remove(next(b for b in plain if b[1] == full and b[0] not in gone))
            own = [bins, 0]
            plain.append(own)
            bins += 1
            assert (number, offset) == (own[0], 0)
        own[1] += x
        if own[1] == 1024:
            plain.remove(own)


def _packed(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset long, length string")
    return [r.asDict() for r in packing.pack(docs, PATH, **kw).collect()]


def test_packing_is_whole_and_gapless(spark, tok):
    texts = [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect()]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "no id", 1, "x"), (3, None, 1, "x"), (3, None, 1, "x")]
    for kw, waste in (({}, 0.02), ({"pieces_per_packer": 20, "open_bins": 8}, 0.1)):
        got = _packed(spark, rows, **kw)
        expected = []
        for i, t, *_ in rows:
            ids = tok.raw(t or "") + np.array([2], "<u4").tobytes()
            expected += [(i, k, s, n, zlib.crc32(ids[4 * s:4 * (s + n)]))
                         for k, (s, n) in enumerate(packing.pieces_of(len(ids) // 4))]
        assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], key=repr) == \
            sorted(expected, key=repr)
        by = {}
        for r in got:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in by.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
        least = -(-sum(r["length"] for r in got) // 1024)
        assert len(by) <= (1 + waste) * least + 2


def test_packing_empty_table(spark):
    assert _packed(spark, []) == []


def test_sequences_hold_the_ids(spark, tok):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e " * 900), (3, None)], "doc_id long, text string")
    ids = packing.tokenised(docs, PATH, with_ids=True)
    out = packing.sequences(ids, packing.pack(docs, PATH)).collect()
    total = b"".join(bytes(r.ids) for r in out)
    whole = [tok.raw(t or "") + np.array([2], "<u4").tobytes() for t in ("a b c", "d e " * 900, None)]
    assert len(total) == sum(map(len, whole)) and all(len(r.ids) <= 4096 for r in out)


def test_rows_of_one_text_are_dealt_to_many_packers(spark, monkeypatch):
    """Null ids with equal texts are repeated rows; no packer gets them all."""
    seen = []
    real = packing._spread

    def spread(rows, packers, *keys):
        out = real(rows, packers, *keys)
        if keys == ("_row",):
            seen.append([r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()])
        return out

    monkeypatch.setattr(packing, "_spread", spread)
    docs = spark.createDataFrame([(None, "the same few words")] * 400, "doc_id long, text string").repartition(3)
    rows = packing.pack(docs, PATH, pieces_per_packer=50).collect()
    assert len(rows) == 400 and sum(seen[0]) == 400 and max(seen[0]) < 100
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
