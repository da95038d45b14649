"""Token files: frequency-ranked ids in a byte-aligned variable-length code.

Ids are replaced by their rank in the whole corpus (0 is the commonest), and a
rank takes one to four bytes. The byte counts stand apart from the bytes, two
bits for each rank, four ranks to a control byte, as in Lemire, Kurz and Rupp,
"Stream VByte" (2018). A control byte picks a row of a 256 x 16 table, which
says where the next data bytes fall in four 32-bit words; numpy decodes a block
by that one lookup.

A file is: magic; the table of ids by rank; blocks of at most ``BLOCK`` ids
(count, number of data bytes, control bytes, data bytes) up to a block of count
zero; then the directory: documents, doc_id flags, doc_ids, token counts. All
numbers are little-endian. Files follow each other in ascending order of
doc_id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import new_path, stored
from .words import encoder, vocabulary_path

MAGIC = b"PQTOKEN1"
BLOCK = 1 << 18
#: Bytes of ids in an Arrow batch between Spark and Python.
BATCH_BYTES = 16 << 20

_PLACES = np.arange(16) % 4 <= np.repeat((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3, 4, axis=1)


def encode_block(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks (uint32); the last control byte is filled up with rank 0."""
    padded = np.zeros(-(-len(ranks) // 4) * 4, "<u4")
    padded[: len(ranks)] = ranks
    more = (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    control = (more.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), padded.view(np.uint8).reshape(-1, 16)[_PLACES[control]].tobytes()


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of a block."""
    places = _PLACES[np.frombuffer(control, np.uint8)]
    out = np.zeros(places.shape, np.uint8)
    out[places] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)[:n]


class TokenFileWriter:
    """Writes documents one after the other; holds a block and the directory."""

    def __init__(self, out, id_of_rank: np.ndarray):
        self.out = out
        self.rank_of_id = np.zeros(int(id_of_rank.max(initial=0)) + 1, "<u4")
        self.rank_of_id[id_of_rank] = np.arange(len(id_of_rank))
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        out.write(MAGIC + struct.pack("<I", len(id_of_rank)) + id_of_rank.astype("<u4").tobytes())

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.held.append(self.rank_of_id[ids])
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ranks = np.concatenate([np.zeros(0, "<u4"), *self.held])
        whole = len(ranks) if last else len(ranks) // BLOCK * BLOCK
        for at in range(0, whole, BLOCK):
            part = ranks[at : min(at + BLOCK, whole)]
            control, data = encode_block(part)
            self.out.write(struct.pack("<II", len(part), len(data)) + control + data)
        self.held, self.n_held = [ranks[whole:]], len(ranks) - whole

    def close(self) -> None:
        self._flush(last=True)
        self.out.write(struct.pack("<II", 0, 0) + struct.pack("<Q", len(self.counts)))
        self.out.write(np.array([d is None for d in self.doc_ids], np.uint8).tobytes())
        self.out.write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes() + np.array(self.counts, "<i8").tobytes())


def read_token_file(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of a seekable file in order; a block and one document are in memory at a time."""

    def number(form: str) -> tuple[int, ...]:
        return struct.unpack(form, source.read(struct.calcsize(form)))

    if source.read(8) != MAGIC:
        raise ValueError("not a token file")
    id_of_rank = np.frombuffer(source.read(4 * number("<I")[0]), "<u4")
    first = source.tell()
    while (head := number("<II"))[0]:  # to the directory
        source.seek(source.tell() + -(-head[0] // 4) + head[1])
    (docs,) = number("<Q")
    null = np.frombuffer(source.read(docs), np.uint8)
    doc_ids = np.frombuffer(source.read(8 * docs), "<i8")
    counts = np.frombuffer(source.read(8 * docs), "<i8")
    source.seek(first)
    held: np.ndarray = np.zeros(0, "<u4")
    for k in range(docs):
        parts, have = [held], len(held)
        while have < counts[k]:
            n, size = number("<II")
            control = source.read(-(-n // 4))
            parts.append(id_of_rank[decode_block(control, source.read(size), n)])
            have += n
        ids = np.concatenate(parts) if len(parts) > 1 else held
        yield (None if null[k] else int(doc_ids[k])), ids[: counts[k]]
        held = ids[counts[k] :]


def batches(rows: Iterable[tuple], schema: pa.Schema, size: Callable[[tuple], int] = lambda row: 64) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded bytes."""
    held: list[tuple] = []
    total = 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= BATCH_BYTES or len(held) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian, two bytes each; four if the vocabulary needs them) of each text, ``end_id`` behind it. A null text has only ``end_id``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("wide", pa.bool_()), ("ids", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)

        def rows():
            for part in parts:
                for doc_id, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist())):
                    ids = np.append(ids, np.uint32(end_id))
                    wide = bool(ids.max() > 0xFFFF)
                    yield doc_id, len(ids), wide, ids.astype("<u4" if wide else "<u2").tobytes()

        yield from batches(rows(), schema, lambda row: len(row[3]))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, wide boolean, ids binary")


def _ids(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if wide else "<u2")


def rank_table(tokens: DataFrame) -> np.ndarray:
    """All ids of the corpus, commonest first, ties by id. What comes to the driver is bounded by the vocabulary."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for part in parts:
            for wide, raw in zip(part.column(0).to_pylist(), part.column(1)):
                got = np.bincount(_ids(raw.as_buffer(), wide))
                if len(got) > len(total):
                    total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
                total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    found = tokens.select("wide", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return found.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.uint32)


def write_token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, folder: str | None = None, tokens_per_file: int = 1 << 23) -> DataFrame:
    """Tokenizes every whole text and writes token files in ascending order of doc_id.

    ``docs`` needs doc_id and text; other columns, whatever their names, are not
    read. Returns a table of one row per file: path, start (ids before the
    file), n_docs, n_tokens. ``folder`` is a URI that pyarrow can write (default: a new one in
    the shared folder).

    Null texts count as empty: only the end id. Null doc_ids come first. Rows
    with one doc_id follow each other by a hash of their ids, then by the ids;
    the same row twice is two documents. An empty table gives no rows of the
    manifest. Texts of any length are taken whole. A doc_id that holds many
    rows is spread over files by that hash.

    A task that is run again writes the same bytes under the same name: it
    renames a finished file into place.
    """
    spark = docs.sparkSession
    tokens = stored(tokenize(docs, tokenizer or vocabulary_path(), end_id).withColumn("tie", F.xxhash64("ids")), "tokens")
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    ranks = rank_table(tokens)
    folder = (folder or new_path(spark, "token-files")).rstrip("/")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/part-{task.partitionId():06d}.tok"
        attempt = f"{base}/.part-{task.partitionId():06d}-{task.taskAttemptId()}"
        writer = None
        for part in parts:
            for doc_id, wide, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                if writer is None:
                    out = store.open_output_stream(attempt)
                    writer = TokenFileWriter(out, ranks)
                writer.add(doc_id, _ids(raw.as_buffer(), wide))
        if writer:
            writer.close()
            out.close()
            store.move(attempt, name)
            found = [pa.array([task.partitionId()], pa.int64()), pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"]), pa.array([len(writer.counts)], pa.int64()), pa.array([sum(writer.counts)], pa.int64())]
            yield pa.RecordBatch.from_arrays(found, names=["part", "path", "n_docs", "n_tokens"])

    files = (
        tokens.repartitionByRange(max(1, -(-total // tokens_per_file)), F.asc_nulls_first("doc_id"), "tie")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie", "ids")
        .select("doc_id", "wide", "ids")
        .mapInArrow(write, "part long, path string, n_docs long, n_tokens long")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    start = F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start")
    return stored(files, "manifest", tokens).select("path", start, "n_docs", "n_tokens")


def read_token_files(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """The documents of the files of a manifest: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for path, start in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    store, name = pafs.FileSystem.from_uri(path)
                    with store.open_input_file(name) as source:
                        for doc_id, ids in read_token_file(source):
                            yield (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) + (ids.astype(np.int32),) * with_ids
                            start += len(ids)

        yield from batches(rows(), schema, (lambda row: 4 * row[2]) if with_ids else lambda row: 32)

    count = max(1, files.count())
    return files.select("path", "start").repartitionByRange(count, "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
