"""Byte-level BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the last 32 bytes cuts texts into chunks where the content
says so, hence passages that documents share mostly give the same chunks.
Chunks that occur more than once are encoded once and joined to their texts;
all others are encoded where they stand.

A chunk's own ids hold only between its first and last *safe cut*: a space
before a non-space character, where the pre-tokeniser starts a new piece in
any surroundings. What lies between the last safe cut of one chunk and the
first safe cut of the next is encoded again as one window; the window grows
over chunks without a safe cut, so both its ends agree with the encoding of
the whole text and the result is exact.

Steps: (1) chunk hashes are counted over all documents, summed in each task
first; (2) hashes met twice or more go into a bit set of fixed size
(``SKETCH_BITS``), a false hit of which only sends a chunk the longer way;
(3) a pass over the documents encodes all unmarked chunks, finishes documents
without a marked one, and hands on the others; (4) marked chunks are encoded
once each; (5) they are joined to the distinct texts that hold them, and these
to their documents. Nothing but marked chunks and pieces of documents with a
marked chunk is shuffled, and a hot chunk or copied text is summed in each
task before.

Defined cases: a null text is empty and has no ids. Rows are documents of their
own, so repeated rows and ids are all encoded. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType)

from hearth.llm.common import map_rows, staged, texts
from hearth.llm.tokens import ByteBpe

#: Mean, least and greatest bytes of a chunk; the cut mask gives the mean.
MEAN_BITS, LEAST, GREATEST = 10, 256, 8192
SKETCH_BITS = 27
_SENT_CHUNKS = 1 << 18

#: A pre-tokeniser piece starts before each of these spaces, whatever stands around.
SAFE_CUT = re.compile(r" (?=\S)")

DONE, WAITING, LOCAL, SHARED, CHUNK = range(5)


def _mixed(n: int) -> np.ndarray:
    """Fixed pseudo-random numbers for the rolling hash."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


def chunks(data: bytes, table: np.ndarray) -> list[bytes]:
    """Content-defined chunks of UTF-8 text; no cut is inside a character."""
    if len(data) <= LEAST:
        return [data] if data else []
    b = np.frombuffer(data, np.uint8)
    h = table[b]
    for k in (1, 2, 4, 8, 16):  # the hash of 2k bytes from two hashes of k bytes
        wider = h.copy()
        wider[k:] += h[:-k] << np.uint32(k)
        h = wider
    out, start = [], 0
    for at in [*(np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1).tolist(), len(data)]:
        while at - start > GREATEST:
            start = _cut(b, data, out, start, start + GREATEST)
        if at - start >= LEAST and at < len(data):
            start = _cut(b, data, out, start, at)
    if start < len(data):
        out.append(data[start:])
    return out


def _cut(b: np.ndarray, data: bytes, out: list[bytes], start: int, at: int) -> int:
    while at < len(b) and b[at] & 0xC0 == 0x80:
        at += 1
    out.append(data[start:at])
    return at


@dataclass(frozen=True)
class Encoded:
    """A run of text: ``ids`` between its first and last safe cut, the text before and
    after; without a safe cut all of it is ``head``."""

    head: str
    ids: bytes
    tail: str
    cut: bool

    @classmethod
    def of(cls, text: str, bpe: ByteBpe) -> Encoded:
        first = SAFE_CUT.search(text)
        if first is None:
            return cls(text, b"", "", False)
        last = first.start()
        at = text.rfind(" ")
        while at > last:  # the last space that a non-space character follows
            if SAFE_CUT.match(text, at):
                last = at
                break
            at = text.rfind(" ", 0, at)
        return cls(text[:first.start()], bpe.ids(text[first.start():last]), text[last:], True)


def joined(runs: Iterator[tuple[str, bytes, str, bool]], bpe: ByteBpe) -> bytes:
    """The ids of a whole text from its runs in order; every join is encoded again."""
    out, window = [], ""
    for head, ids, tail, cut in runs:
        window += head
        if cut:
            out += [bpe.ids(window), ids]
            window = tail
    return b"".join([*out, bpe.ids(window)])


@dataclass(frozen=True)
class Finish:
    """What to keep of each document: a schema, and the values from its ids."""

    schema: StructType
    values: Callable[[ByteBpe, bytes], tuple]


#: All ids, little-endian unsigned 32-bit.
IDS = Finish(StructType([StructField("ids", BinaryType())]), lambda bpe, ids: (ids,))

_HASHES = StructType([StructField("hash", LongType(), False), StructField("n", LongType(), False)])
_PIECE = [StructField("chunk", BinaryType()), StructField("head", StringType()), StructField("ids", BinaryType()),
          StructField("tail", StringType()), StructField("cut", BooleanType())]
_HANDED = [StructField("kind", IntegerType(), False), StructField("doc_id", LongType()),
           StructField("key", BinaryType()), StructField("seq", IntegerType()),
           *[StructField(f"_{f.name}", f.dataType) for f in _PIECE]]


def repeated_chunks(docs: DataFrame) -> np.ndarray:
    """The bit set of the hashes of chunks that occur twice or more."""
    table = _mixed(256)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        import xxhash
        for b in batches:
            found = [xxhash.xxh3_64_intdigest(c) for t in texts(b["text"])
                     for c in chunks(t.encode("utf-8", "surrogatepass"), table)]
            h, n = np.unique(np.array(found, np.uint64), return_counts=True)
            yield {"hash": h.view(np.int64), "n": n}

    counted = map_rows(docs.select("text"), _HASHES, run).groupBy("hash").agg(F.sum("n").alias("n"))
    place = F.pmod(F.col("hash"), F.lit(1 << SKETCH_BITS)) + 1
    parts = (counted.where(F.col("n") > 1).groupBy(F.bitmap_bucket_number(place).alias("part"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")))
    out = np.zeros((1 << SKETCH_BITS) // 8, np.uint8)
    for r in parts.toLocalIterator():  # at most 2 ** SKETCH_BITS bits in all
        at = (r["part"] - 1) * 4096
        out[at:at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _hand_on(docs: DataFrame, path: str, marked, finish: Finish) -> DataFrame:
    """Step 3: rows of kind DONE (a document's values), WAITING (a document and its text's
    key), LOCAL and SHARED (the runs of a waiting text) and CHUNK (a marked chunk's text)."""
    table = _mixed(256)
    names = [f.name for f in _HANDED]
    schema = StructType([*_HANDED, *finish.schema.fields])
    none = (None,) * len(finish.schema)
    modulus = np.uint64((1 << SKETCH_BITS) - 1)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        import hashlib

        import xxhash
        bpe, bits = ByteBpe.of(path), marked.value
        sent: set[bytes] = set()
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b["doc_id"], texts(b["text"]), strict=True):
                own = doc_id.as_py()
                data = text.encode("utf-8", "surrogatepass")
                parts = chunks(data, table)
                place = np.array([xxhash.xxh3_64_intdigest(c) for c in parts], np.uint64) & modulus
                hit = (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
                if not hit.any():
                    rows.append((DONE, own, None, None, None, None, None, None, None,
                                 *finish.values(bpe, bpe.ids(text))))
                    continue
                key = hashlib.md5(data).digest()
                rows.append((WAITING, own, key, None, None, None, None, None, None, *none))
                run_start = None
                for seq in range(len(parts) + 1):
                    if seq < len(parts) and not hit[seq]:
                        run_start = seq if run_start is None else run_start
                        continue
                    if run_start is not None:
                        e = Encoded.of(b"".join(parts[run_start:seq]).decode("utf-8", "surrogatepass"), bpe)
                        rows.append((LOCAL, None, key, run_start, None, e.head, e.ids, e.tail, e.cut, *none))
                        run_start = None
                    if seq < len(parts):
                        name = xxhash.xxh3_128_digest(parts[seq])
                        rows.append((SHARED, None, key, seq, name, None, None, None, None, *none))
                        if name not in sent:
                            if len(sent) >= _SENT_CHUNKS:
                                sent.clear()
                            sent.add(name)
                            rows.append((CHUNK, None, None, None, name,
                                         parts[seq].decode("utf-8", "surrogatepass"), None, None, None, *none))
            columns = zip(*rows, strict=True) if rows else [()] * len(schema)
            yield dict(zip([*names, *finish.schema.names], columns, strict=True))

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), schema, run)


def encode(docs: DataFrame, path: str, finish: Finish = IDS) -> DataFrame:
    """``doc_id`` and the columns of ``finish`` for every row of ``docs(doc_id, text)``;
    the ids are those that the ``tokenizers`` library gives for the file at ``path``
    without added special tokens."""
    docs = docs.select("doc_id", "text")
    marked = docs.sparkSession.sparkContext.broadcast(repeated_chunks(docs))
    handed = staged(_hand_on(docs, path, marked, finish), "bpe")
    of = {k: handed.where(F.col("kind") == k) for k in range(5)}
    piece = StructType(_PIECE)

    def encode_chunks(batches: Iterator[dict]) -> Iterator[dict]:
        bpe = ByteBpe.of(path)
        for b in batches:
            found = [Encoded.of(t, bpe) for t in texts(b["text"])]
            yield {"chunk": b["chunk"].to_pylist(), "head": [e.head for e in found], "ids": [e.ids for e in found],
                   "tail": [e.tail for e in found], "cut": [e.cut for e in found]}

    once = of[CHUNK].groupBy(F.col("_chunk").alias("chunk")).agg(F.first("_head").alias("text"))
    encoded = map_rows(once, piece, encode_chunks)
    uses = of[SHARED].groupBy("key", "seq").agg(F.first("_chunk").alias("chunk"))
    values = ["head", "ids", "tail", "cut"]
    runs = uses.join(encoded, "chunk").select("key", "seq", *values).unionByName(
        of[LOCAL].select("key", "seq", *[F.col(f"_{c}").alias(c) for c in values]))
    whole = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", *values))).alias("runs"))
    by_text = StructType([StructField("key", BinaryType()), *finish.schema.fields])

    def assemble(batches: Iterator[dict]) -> Iterator[dict]:
        bpe = ByteBpe.of(path)
        for b in batches:
            found = []
            for key, own in zip(b["key"].to_pylist(), b["runs"], strict=True):
                ids = joined(((r["head"], r["ids"], r["tail"], r["cut"]) for r in own.as_py()), bpe)
                found.append((key, *finish.values(bpe, ids)))
            yield dict(zip(by_text.names, zip(*found, strict=True) if found else [()] * len(by_text), strict=True))

    texts_done = map_rows(whole, by_text, assemble)
    names = finish.schema.names
    return of[DONE].select("doc_id", *names).unionByName(
        of[WAITING].select("doc_id", "key").join(texts_done, "key").select("doc_id", *names))


def decode(ids: Column, path: str) -> Column:
    """The text of a column of ids (little-endian unsigned 32-bit)."""

    @F.pandas_udf(StringType())
    def text_of(column: pd.Series) -> pd.Series:
        bpe = ByteBpe.of(path)
        return column.map(lambda v: None if v is None else bpe.text(np.frombuffer(v, "<u4")))

    return text_of(ids)
