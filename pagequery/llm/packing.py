"""Packing of tokenized documents into sequences: bounded-space online best-fit.

A fixed number of bins is open at a time. Their free spaces are the set bits of
one integer: the smallest space that takes a piece is the lowest set bit at or
above the piece's length. If none fits, a new bin opens, and where all places
are taken the fullest bin closes first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .token_file import batches
from .words import encoder, vocabulary_path


class BestFit:
    """Online best-fit over at most ``open_bins`` open bins of ``size`` tokens."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.spaces = 0
        self.by_space: dict[int, list[int]] = {}
        self.n_open = self.opened = 0

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        found = bins.pop()
        if not bins:
            del self.by_space[space]
            self.spaces &= ~(1 << space)
        self.n_open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of the next piece."""
        fits = self.spaces >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            chosen = self._take(space)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            space, chosen = self.size, self.opened
            self.opened += 1
        left = space - length
        if left:
            self.by_space.setdefault(left, []).append(chosen)
            self.spaces |= 1 << left
            self.n_open += 1
        return chosen, self.size - space


def pieces_of(docs: DataFrame, path: str, end_id: int, size: int, with_ids: bool) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32 and, if wanted, ids. Only documents over ``size`` tokens have more than one."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)

        def rows():
            for part in parts:
                for doc_id, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist())):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), size)):
                        own = ids[start : start + size]
                        yield (doc_id, k, start, len(own), zlib.crc32(own.tobytes())) + (own.astype(np.int32),) * with_ids

        yield from batches(rows(), schema, (lambda row: 4 * row[3]) if with_ids else lambda row: 40)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, size: int = 4096, open_bins: int = 64, group_sequences: int = 3000, group_rows: int = 1_000_000, with_ids: bool = True) -> DataFrame:
    """Packs all documents into sequences of at most ``size`` tokens.

    ``docs`` needs doc_id and text; other columns, whatever their names, are not
    read. Returns a row per piece: doc_id, piece, start, length, ids_crc32,
    [ids,] sequence_id, offset. The pieces of a sequence in order of offset,
    laid end to end, are the sequence.

    Documents over ``size`` tokens are cut; a piece of exactly ``size`` tokens
    is a sequence by itself. The rest is dealt by a hash of a row number (not
    of a key, so no key can overfill a group) to groups of about
    ``group_sequences`` sequences' worth of tokens and ``group_rows`` pieces at
    most on average, so tasks stay of one size however large the corpus and
    however short its texts. Each group is a stream of its own, in the order of
    the rows, and has at most ``open_bins`` bins open.

    A null text is an empty document of one token, the end id. Null and
    repeated doc_ids are documents like others. An empty table gives no rows.
    """
    pieces = stored(pieces_of(docs, tokenizer or vocabulary_path(), end_id, size, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    loose = pieces.where(F.col("length") < size)
    tokens, rows = loose.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-tokens // (size * group_sequences)), -(-rows // group_rows))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        numbers, lengths = table.column("row").to_numpy(), table.column("length").to_numpy()
        order = np.argsort(numbers)
        bins = BestFit(size, open_bins)
        chosen, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        for k, at in enumerate(order):
            chosen[k], offset[k] = bins.place(int(lengths[at]))
        return pa.table({"row": numbers[order], "sequence_id": (np.int64(key[0].as_py()) << 32) + chosen, "offset": offset})

    placed = (
        loose.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("bag"))
        .groupBy("bag").applyInArrow(pack, "row long, sequence_id long, offset long")
    )
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset"]
    alone = pieces.where(F.col("length") == size).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    return loose.join(placed, "row").select(names).unionByName(alone.select(names))
