"""Nearest neighbours by multi-index hashing over learned binary codes.

Codes: vectors are centred, rotated to their principal axes and then by the
rotation of iterative quantization (Gong and Lazebnik, 2011) that brings them
closest to the corners of a cube; signs are the bits. Inner products become
angles by one more coordinate, as in Neyshabur and Srebro (2015).

Search: a code is split into substrings, each with an index of its own (Norouzi,
Punjani and Fleet, 2012). Codes within radius r of the query agree with it, in
one substring at least, to within r / substrings: probing every index there
finds them all. Floats rank what is found.

The radius is each query's own. Its k-th best score in a small sample is a bound
below which no answer lies; how far codes differ at such a score is learned. So
queries in dense places probe little, others much. A query that ends with fewer
than k answers meets all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .vectors import matrix, usable

#: Rows of an index block, and queries that meet it at once.
BLOCK, QUERIES = 8192, 4096


@dataclass(frozen=True)
class CodeModel:
    """How vectors become codes, and how far the codes of a query and of a row differ: ``slope`` x (bits that their angle makes expect) + ``base`` at most, but for a small share."""

    mean: np.ndarray
    axes: np.ndarray
    longest: float
    slope: float = 0.0
    base: float = math.inf

    @property
    def bits(self) -> int:
        return self.axes.shape[1]

    def radius(self, queries: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits in which the code of a row that scores a query's bound or more differs from the query's, but for the share that was left out in learning."""
        cosine = bounds / (np.sqrt((queries * queries).sum(axis=1)) * self.longest)
        wanted = self.slope * np.arccos(np.clip(cosine, -1, 1)) / np.pi * self.bits + self.base
        return np.where(np.isfinite(bounds) & np.isfinite(wanted), np.clip(np.ceil(np.nan_to_num(wanted, posinf=self.bits)), 0, self.bits), self.bits).astype(np.int64)

    def codes(self, vectors: np.ndarray, stored_rows: bool) -> np.ndarray:
        """Substrings of up to 8 bits of each row; queries have nothing in the added coordinate."""
        lengths = (vectors * vectors).sum(axis=1)
        extra = np.sqrt(np.maximum(0, self.longest**2 - lengths)) if stored_rows else np.zeros(len(vectors))
        whole = np.column_stack([vectors / (self.longest if stored_rows else np.sqrt(lengths)[:, None]), extra / self.longest])
        return np.packbits((whole - self.mean) @ self.axes > 0, axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which codes differ."""
    if a.shape[-1] % 8 == 0 and a.flags.c_contiguous and b.flags.c_contiguous:  # eight bytes at once
        a, b = a.view(np.uint64), b.view(np.uint64)
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


#: Bits in which any two bytes differ.
_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))


def fit_codes(sample: np.ndarray, longest: float, k: int, recall: float = 0.97, max_bits: int = 64, rounds: int = 40) -> CodeModel:
    """Learns the axes from sampled rows, and from the nearest of some of them how the distance of codes follows the angle; ``recall`` of these lie within the radius."""
    lengths = (sample * sample).sum(axis=1)
    whole = np.column_stack([sample / longest, np.sqrt(np.maximum(0, longest**2 - lengths)) / longest])
    mean = whole.mean(axis=0)
    bits = max(1, min(max_bits, sample.shape[1]))
    axes = np.linalg.eigh(np.cov(whole, rowvar=False, bias=True))[1][:, ::-1][:, :bits]
    flat = (whole - mean) @ axes
    turn = np.linalg.qr(np.random.default_rng(11).standard_normal((axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
        turn = (u @ v).T
    model = CodeModel(mean, axes @ turn, longest)
    asked = sample[:256]
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    k = min(4 * k, len(sample) - 1)
    if k < 8:
        return model
    nearest = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    rows, queries = model.codes(sample, True), model.codes(asked, False)
    far = np.concatenate([distances(rows[nearest[i]], queries[i]) for i in range(len(asked))])
    cosine = np.take_along_axis(scores, nearest, axis=1) / (np.sqrt((asked * asked).sum(axis=1))[:, None] * longest)
    wanted = np.arccos(np.clip(cosine.ravel(), -1, 1)) / np.pi * model.bits
    spread = wanted - wanted.mean()
    slope = max(0.0, float((spread * far).sum() / max(1e-9, (spread * spread).sum())))
    return CodeModel(mean, model.axes, longest, slope, float(np.quantile(far - slope * wanted, recall)))


class MultiIndex:
    """An index for each substring of the codes of a block."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(c, kind="stable").astype(np.int32) for c in codes.T]
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(c, minlength=256))]) for c in codes.T]
        self.probed: dict[tuple[int, int, int], np.ndarray] = {}
        self.touched = 0

    def _probe(self, part: int, value: int, radius: int) -> np.ndarray:
        """Rows whose substring is within ``radius`` of ``value``; kept, as other queries ask the same."""
        key = (part, value, radius)
        if key not in self.probed:
            values = np.flatnonzero(_NEAR[value] <= radius)
            starts, order = self.starts[part], self.order[part]
            self.probed[key] = np.concatenate([order[starts[v] : starts[v + 1]] for v in values])
        return self.probed[key]

    def _expected(self, part: int, value: int, radius: int) -> int:
        """Rows in the probed places of one index."""
        if radius < 0:
            return 0
        near = _NEAR[value] <= radius
        return int(np.diff(self.starts[part])[near].sum())

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is within ``radius`` of the query's, by pigeonhole: with r = parts * q + s, some of the first s + 1 substrings is within q or some other within q - 1. Where the indexes would give more entries than there are codes, the codes are gone through instead, to the same end."""
        parts = len(query)
        q, s = divmod(radius, parts)
        reaches = [q if part <= s else q - 1 for part in range(parts)]
        if sum(self._expected(part, int(query[part]), r) for part, r in enumerate(reaches)) > len(self.codes):
            self.touched += len(self.codes)
            return np.flatnonzero(distances(self.codes, query) <= radius)
        seen = np.zeros(len(self.codes), bool)
        for part, reach in enumerate(reaches):
            if reach >= 0:
                seen[self._probe(part, int(query[part]), reach)] = True
        rows = np.flatnonzero(seen)
        self.touched += len(rows)
        return rows[distances(self.codes[rows], query) <= radius]


def search_block(model: CodeModel, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, radii: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the query, rows, scores) of the ``k`` best within the query's radius in a block, none below its bound."""
    index = MultiIndex(model.codes(vectors, True))
    for n, code in enumerate(model.codes(queries, False)):
        rows = index.within(code, int(radii[n]))
        rows = rows[ids[rows] != query_ids[n]]
        if not len(rows):
            continue
        rough = vectors[rows] @ queries[n]
        slack = 1e-9 * max(1.0, float(np.abs(rough).max()))  # ties and rounding stay in
        least = max(bounds[n], np.partition(rough, -k)[-k]) if len(rows) > k else bounds[n]
        rows = rows[rough >= least - slack]
        if len(rows):
            scores = (vectors[rows] * queries[n]).sum(axis=1)
            best = np.lexsort((ids[rows], -scores))[:k]
            yield n, rows[best], scores[best]


def _searcher(model: CodeModel, k: int):
    def search(have: pa.Table, want: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        if len(have) and len(want):
            ids, query_ids, hashes = have.column("vec_id").to_numpy(), want.column("vec_id").to_numpy(), want.column("h").to_numpy()
            bounds, radii = want.column("bound").to_numpy(), want.column("radius").to_numpy()
            for n, at, scores in search_block(model, ids, matrix(have.column("embedding")), query_ids, matrix(want.column("embedding")), bounds, radii, k):
                for held, new in zip(out, (np.full(len(at), query_ids[n]), np.full(len(at), hashes[n]), ids[at], scores)):
                    held.append(new)
        merged = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(("query_id", "h", "vec_id", "score"), merged)))

    return search


def bounds_of(ids: np.ndarray, sample: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th best score of each query in a sample without its own rows; minus infinity where there are fewer."""
    out = np.full(len(queries), -np.inf)
    for n in range(len(queries)):
        scores = (sample @ queries[n])[ids != query_ids[n]]
        if len(scores) >= k:
            out[n] = np.partition(scores, -k)[-k]
    return out - 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(out), out, 0)))


def _bounded(asked: DataFrame, model: CodeModel, ids: np.ndarray, sample: np.ndarray, k: int) -> DataFrame:
    """Adds bound, radius and h, the query row's hash."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            queries = matrix(part.column("embedding"))
            bounds = bounds_of(ids, sample, part.column("vec_id").to_numpy(), queries, k)
            yield part.append_column("bound", pa.array(bounds, pa.float64())).append_column("radius", pa.array(model.radius(queries, bounds), pa.int64()))

    return stored(asked.select("vec_id", "embedding", F.xxhash64("embedding", "vec_id").alias("h")).mapInArrow(run, f"vec_id long, embedding {dict(asked.dtypes)['embedding']}, h long, bound double, radius long"), "queries")


def _met(rows: DataFrame, asked: DataFrame, model: CodeModel, k: int, blocks: int, sets: int) -> DataFrame:
    """What each set of queries finds in each block of rows."""
    left = rows.withColumn("block", F.pmod(F.xxhash64("embedding", "vec_id"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    right = asked.withColumn("part", F.pmod("h", F.lit(sets)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return stored(
        left.select("block", "part", "vec_id", "embedding").groupBy("block", "part")
        .cogroup(right.select("block", "part", "vec_id", "embedding", "h", "bound", "radius").groupBy("block", "part"))
        .applyInArrow(_searcher(model, k), "query_id long, h long, vec_id long, score double"),
        "found",
    )


def nearest_neighbours(embeddings: DataFrame, queries: DataFrame, k: int = 20, sample_rows: int = 8192) -> DataFrame:
    """The ``k`` rows of ``embeddings`` of largest inner product found for each row of ``queries``: query_id, rank, vec_id, score.

    Both need vec_id and embedding; other columns are not read. The codes are
    learned from at most ``sample_rows`` rows (the least by a hash), and an
    eighth of the rows, ``sample_rows`` at most, bounds the scores; every row is
    indexed. The index is made in blocks of about ``BLOCK`` rows, and each set
    of ``QUERIES`` queries meets each block; a block answers with its ``k`` best
    above the query's bound.

    Rows with the query's vec_id are its own and never its answer. Ties go to
    the smaller vec_id. Vectors that are null, empty, zero or hold null or
    non-finite numbers, and null vec_ids, take no part; queries meet only
    vectors of their length. A query row that repeats is asked once; candidate
    rows that repeat are answers each. An empty table gives no rows.
    """
    spark = embeddings.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).withColumn("dim", F.size("embedding"))

    rows, asked = clean(embeddings), stored(clean(queries).distinct(), "queries")
    found = None
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.sqrt(F.max(squares)).alias("longest"))
    for size in sizes.join(asked.groupBy("dim").agg(F.count("*").alias("asked")), "dim").collect():  # a row per length of vector
        own = rows.where(F.col("dim") == size.dim)
        drawn = own.select("vec_id", "embedding", F.xxhash64("embedding", "vec_id").alias("h")).orderBy("h").limit(sample_rows).select("vec_id", "embedding").toArrow()
        sample, ids = matrix(drawn.column(1)), drawn.column(0).to_numpy()
        model = fit_codes(sample, size.longest, k)
        few = max(1, min(sample_rows, size.n // 8))
        wanted = _bounded(asked.where(F.col("dim") == size.dim), model, ids[:few], sample[:few], k)
        blocks, sets = -(-size.n // BLOCK), -(-size.asked // QUERIES)
        part = _met(own, wanted, model, k, blocks, sets)
        # Whoever has fewer than k answers, though there are more rows, meets them all.
        short = wanted.join(part.groupBy("h").count().where(F.col("count") >= k).select("h"), "h", "left_anti").where("radius < " + str(model.bits))
        short = stored(short.withColumns({"bound": F.lit(float("-inf")), "radius": F.lit(model.bits).cast("long")}).select("vec_id", "embedding", "h", "bound", "radius"), "short")
        if not short.isEmpty():
            part = part.join(short.select("h"), "h", "left_anti").select("query_id", "h", "vec_id", "score").unionByName(_met(own, short, model, k, blocks, max(1, -(-short.count() // QUERIES))))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    from pyspark.sql import Window

    best = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
