"""Best-fit packing of tokenised documents into fixed-length sequences.

Bounded-space online best-fit: a packer holds at most ``open_bins`` open bins.
The open bins are keyed by free space, a bitset has a bit for every free space
that occurs, and a piece goes to the open bin with the least free space that
holds it. If there is none a new bin opens; when that would be one too many,
the fullest open bin closes.

On Spark: one pass tokenises the whole texts and keeps, per piece, only its
place, length and checksum (ids are not shuffled). Pieces of full length are
sequences by themselves; the others are spread by hash over packers of about
``pieces_per_packer`` pieces, which pack them longest first. Bins still open
when a packer ends are packed once more, as whole bundles, by fewer packers,
so splitting the work costs hardly any space. No task holds more than one
packer's pieces at any input size.

Defined cases: a null text is empty, so its document is the end mark alone.
Every row is a document of its own: repeated rows and repeated or null ids are
all packed. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from hearth.llm.common import map_rows, staged, texts
from hearth.llm.tokens import ByteBpe

SEQUENCE = 1024
END_ID = 2
OPEN_BINS = 1 << 14
PIECES_PER_PACKER = 1 << 15

PIECE_SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("piece", IntegerType(), False),
    StructField("start", LongType(), False), StructField("length", LongType(), False),
    StructField("ids_crc32", LongType(), False)])
PACKED_SCHEMA = StructType([*PIECE_SCHEMA.fields, StructField("sequence_id", LongType(), False),
                            StructField("offset", LongType(), False)])
_ROUND_SCHEMA = StructType([*PACKED_SCHEMA.fields, StructField("fill", LongType(), False),
                            StructField("open", BooleanType(), False)])


def pieces_of(length: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: whole if it fits, else full pieces
    after a first one that may be shorter."""
    first = length if length <= size else length % size or size
    return [(0, first)] + [(s, size) for s in range(first, length, size)]


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID, size: int = SEQUENCE,
              with_ids: bool = False) -> DataFrame:
    """One row per piece of every document of ``docs(doc_id, text)``; ``with_ids`` adds
    ``ids`` (little-endian unsigned 32-bit)."""
    end = array("I", [end_id]).tobytes()
    schema = StructType([*PIECE_SCHEMA.fields, *([StructField("ids", BinaryType(), False)] if with_ids else [])])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        bpe = ByteBpe.of(path)
        for b in batches:
            rows: dict[str, list] = {f.name: [] for f in schema}
            for doc_id, text in zip(b["doc_id"], texts(b["text"]), strict=True):
                ids = memoryview(bpe.ids(text) + end)
                for k, (start, length) in enumerate(pieces_of(len(ids) // 4, size)):
                    part = ids[4 * start:4 * (start + length)]
                    for name, v in (("doc_id", doc_id.as_py()), ("piece", k), ("start", start), ("length", length),
                                    ("ids_crc32", zlib.crc32(part))):
                        rows[name].append(v)
                    if with_ids:
                        rows["ids"].append(bytes(part))
            yield rows

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), schema, run)


class BestFit:
    """At most ``open_bins`` open bins; bins are numbered from 0 in order of opening."""

    def __init__(self, open_bins: int = OPEN_BINS, size: int = SEQUENCE):
        self.limit, self.size = open_bins, size
        self.by_space: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = 0  # bit s is set if an open bin has s free
        self.count = self.bins = 0

    def _take(self, space: int) -> int:
        held = self.by_space[space]
        number = held.pop()
        if not held:
            self.bits &= ~(1 << space)
        self.count -= 1
        return number

    def put(self, length: int) -> tuple[int, int]:
        """Place a piece; its bin and offset."""
        fits = self.bits >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.size, self.bins
            self.bins += 1
            if self.count == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        left = space - length
        if left:
            self.by_space[left].append(number)
            self.bits |= 1 << left
            self.count += 1
        return number, self.size - space

    def open_numbers(self) -> set[int]:
        return {n for held in self.by_space for n in held}


def _packer(by_bundle: bool, base: int, open_bins: int, size: int):
    """The function of one packing round: a partition's rows through one :class:`BestFit`.
    With ``by_bundle`` rows of one former sequence stand together and move as one piece."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        fit = BestFit(open_bins, size)
        task = TaskContext.get().partitionId()
        first = base + (task << 40)
        columns = {n: [] for n in PIECE_SCHEMA.names}
        bins, offsets, fills = [], [], {}
        last = number = at = None
        for b in batches:
            lengths = b["length"].to_pylist()
            keys = zip(b["sequence_id"].to_pylist(), b["fill"].to_pylist(), b["offset"].to_pylist(),
                       strict=True) if by_bundle else None
            for length in lengths:
                if by_bundle:
                    key, fill, inside = next(keys)
                    if key != last:
                        last, (number, at) = key, fit.put(fill)
                        fills[number] = at + fill
                    offsets.append(at + inside)
                else:
                    number, at = fit.put(length)
                    fills[number] = at + length
                    offsets.append(at)
                bins.append(number)
            for n in columns:
                columns[n].extend(b[n].to_pylist())
        still = fit.open_numbers()
        yield columns | {"sequence_id": [first + n for n in bins], "offset": offsets,
                         "fill": [fills[n] for n in bins], "open": [n in still for n in bins]}

    return run


def _spread(rows: DataFrame, packers: int, *keys: str) -> DataFrame:
    return rows.repartition(max(1, packers), *[F.col(k) for k in keys])


def packed(pieces: DataFrame, size: int = SEQUENCE, open_bins: int = OPEN_BINS,
           pieces_per_packer: int = PIECES_PER_PACKER) -> DataFrame:
    """Assign every row of ``pieces`` (as :func:`tokenised` gives them) a ``sequence_id``
    and an ``offset``; sequences are filled without gaps from 0."""
    pieces = staged(pieces.select(*PIECE_SCHEMA.names), "pieces")
    whole = pieces.where(F.col("length") == size).select(
        *PIECE_SCHEMA.names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < size)
    n = rest.count()
    # dealt by row, so rows that repeat an id and a text don't meet in one packer
    spread = _spread(rest.withColumn("_row", F.monotonically_increasing_id()), -(-n // pieces_per_packer), "_row").drop("_row")
    once = staged(map_rows(spread.sortWithinPartitions(F.desc("length"), "doc_id", "ids_crc32"), _ROUND_SCHEMA,
                           _packer(False, 0, open_bins, size)), "packed")
    left = once.where("open")
    bundles = left.select("sequence_id").distinct().count()
    again = map_rows(
        _spread(left, -(-bundles // pieces_per_packer), "sequence_id")
        .sortWithinPartitions(F.desc("fill"), "sequence_id", "offset"),
        _ROUND_SCHEMA, _packer(True, 1 << 61, open_bins, size))
    names = PACKED_SCHEMA.names
    return (once.where(~F.col("open")).select(*names).unionByName(again.select(*names))
            .unionByName(whole.select(*names)))


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, end_id: int = END_ID,
         open_bins: int = OPEN_BINS, pieces_per_packer: int = PIECES_PER_PACKER) -> DataFrame:
    """Pack every document of ``docs(doc_id, text)``, tokenised by the file at ``path``."""
    return packed(tokenised(docs, path, end_id, size), size, open_bins, pieces_per_packer)


def sequences(pieces_with_ids: DataFrame, places: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id`` and ``ids`` (little-endian
    unsigned 32-bit). A sequence gathers at most ``SEQUENCE`` ids. ``pieces_with_ids``
    comes from :func:`tokenised` and document ids have to be unique."""
    keys = ["doc_id", "piece"]
    ids = pieces_with_ids.select(*keys, "ids").join(places.select(*keys, "sequence_id", "offset"), keys)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return ids.groupBy("sequence_id").agg(parts.alias("_parts")).select(
        "sequence_id", F.aggregate("_parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def ids_array(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")
