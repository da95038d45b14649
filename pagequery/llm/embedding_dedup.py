"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, components.

The signs of a vector's products with random hyperplanes make a code (Charikar,
2002); vectors that share the code of any table are compared exactly. Equal
vectors are one class first, so copies are never compared with each other.

What is dealt to the tables is a row number and a signature of ``SIGNS`` more
signs, not the vector. Signatures that are too far apart rule a pair out; only
members of a bucket that have another one near them fetch their vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import stored
from .vectors import matrix, usable

#: Vectors of a bucket that one task compares with as many others; larger buckets are cut into blocks, and every pair of blocks is compared.
BLOCK = 1024
#: Bits of a signature.
SIGNS = 256


def table_sizes(vectors: int, threshold: float, missed: float = 1e-4, bucket: int = 256) -> tuple[int, int]:
    """Bits of a code and number of tables. Bits follow the number of vectors so that unrelated ones fill a bucket of about ``bucket``; tables follow the bits, so that a pair exactly at the threshold is missed with probability ``missed`` at any size."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(4, min(30, round(math.log2(max(1, vectors) / bucket))))
    return bits, math.ceil(math.log(missed) / math.log(1 - agree**bits))


def reach(threshold: float, missed: float = 1e-9) -> int:
    """Bits in which the signatures of a pair at the threshold differ at most, but with probability ``missed``."""
    p = math.acos(threshold) / math.pi
    left, d = 1.0, -1
    while left > missed and d < SIGNS:
        d += 1
        left -= math.comb(SIGNS, d) * p**d * (1 - p) ** (SIGNS - d)
    return d


def _coded(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """Adds ``codes``, one number per table, and ``signature``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for part in parts:
            sizes = np.array([len(x) for x in part.column("embedding")])
            for dim in np.unique(sizes):
                own = part.filter(pa.array(sizes == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((dim, tables * bits + SIGNS))
                signs = matrix(own.column("embedding")) @ planes[dim] > 0
                codes = (signs[:, : tables * bits].reshape(len(own), tables, bits) << np.arange(bits)).sum(axis=2, dtype=np.int64).astype(np.int32)
                own = own.append_column("codes", pa.FixedSizeListArray.from_arrays(pa.array(codes.reshape(-1)), tables).cast(pa.list_(pa.int32())))
                yield own.append_column("signature", pa.array([x.tobytes() for x in np.packbits(signs[:, tables * bits :], axis=1)], pa.binary()))

    kind = dict(classes.dtypes)["embedding"]
    return classes.mapInArrow(run, f"id long, n long, embedding {kind}, codes array<int>, signature binary")


def near_members(signatures: np.ndarray, side: np.ndarray, most: int) -> np.ndarray:
    """Which members of a block have another one (of the other side, if there are two) within ``most`` bits."""
    signs = np.unpackbits(signatures, axis=1).astype(np.float32) * 2 - 1
    near = np.zeros(len(signs), bool)
    if side.any():
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        hit = signs[a] @ signs[b].T >= SIGNS - 2 * most
        near[a], near[b] = hit.any(axis=1), hit.any(axis=0)
    else:
        near = (signs @ signs.T >= SIGNS - 2 * most).sum(axis=1) > 1
    return near


def compare_bucket(keys: np.ndarray, counts: np.ndarray, vectors: np.ndarray, codes: np.ndarray, side: np.ndarray, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members with links in a bucket, the vectors they link to, and the least member they hang on.

    ``side`` 0 and 1 are two blocks compared with each other; all 0 is one block
    compared with itself. Pairs that share the code of an earlier table belong there.
    """
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    unit = vectors / norms[:, None]
    cross = side.any()
    a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (np.arange(len(keys)),) * 2
    i, j = np.nonzero(unit[a] @ unit[b].T >= threshold - 1e-9)
    i, j = a[i], b[j]
    if not cross:
        i, j = i[i < j], j[i < j]
    near = np.ones(len(i), bool)
    for at in range(0, len(i), 1 << 16):  # pairs by pairs: the exact measure, and the first table that they share
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        near[at : at + len(p)] = ((vectors[p] * vectors[q]).sum(axis=1) / (norms[p] * norms[q]) >= threshold) & ~(codes[p, :table] == codes[q, :table]).any(axis=1)
    i, j = i[near], j[near]
    links = np.bincount(i, counts[j], len(keys)) + np.bincount(j, counts[i], len(keys))
    label = np.arange(len(keys))
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    has = np.flatnonzero(links > 0)
    return has, links[has].astype(np.int64), label[has]


def embedding_near_duplicates(embeddings: DataFrame, threshold: float = 0.95, seed: int = 5) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    ``embeddings`` needs vec_id and embedding; other columns are not read. Two
    vectors link if their cosine in double precision is ``threshold`` or more.
    n_links counts the other rows linked directly, component_id is the least
    vec_id reachable, kept marks the row that has it.

    Vectors that are null, empty, zero or hold null or non-finite numbers link
    with nothing and stay (component_id is their own vec_id, null if that is
    null; a null vec_id with no other in its component is not kept). Vectors of
    different length never link. Rows that repeat a vec_id are vectors like
    others; all rows that have the least vec_id of a component are kept. An
    empty table gives no rows.
    """
    keys = [F.xxhash64("embedding"), F.xxhash64(F.lit(7), "embedding")]
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("good", usable(F.col("embedding")))
    rows = rows.select("vec_id", "embedding", *[F.when(F.col("good"), key).alias(name) for key, name in zip(keys, ("h", "g"))])
    classes = rows.where("h IS NOT NULL").groupBy("h", "g").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first("embedding").alias("embedding"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "vectors")
    bits, tables = table_sizes(classes.count(), threshold)
    most = reach(threshold)
    coded = stored(_coded(classes.select("id", "n", "embedding"), bits, tables, seed), "codes")
    place = ["dim", "tab", "code"]
    opened = coded.select("id", "signature", F.size("embedding").alias("dim"), F.posexplode("codes").alias("tab", "code"))
    sizes = opened.groupBy(place).count().where("count > 1").select(*place, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    large = stored(sizes.where("blocks > 1"), "large")
    dealt = opened.join(large, place, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"b0": F.least("own", "other"), "b1": F.greatest("own", "other")})
    block = [*place, "b0", "b1"]

    def side_of(key: tuple, group: pa.Table) -> np.ndarray:
        b0, b1 = key[3].as_py(), key[4].as_py()
        return (group.column("own").to_numpy() == b1).astype(np.int8) if b0 != b1 else np.zeros(len(group), np.int8)

    def sift(key: tuple, group: pa.Table) -> pa.Table:
        signatures = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint8).reshape(len(group), -1)
        return group.filter(pa.array(near_members(signatures, side_of(key, group), most))).select([*block, "own", "id"])

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        codes = np.array(group.column("codes").combine_chunks().flatten()).reshape(len(ids), -1)
        has, links, roots = compare_bucket(ids, group.column("n").to_numpy().astype(np.float64), matrix(group.column("embedding")), codes, side_of(key, group), key[1].as_py(), threshold)
        return pa.table({"id": ids[has], "links": links, "root": ids[roots]})

    near = dealt.select(*block, "own", "id", "signature").groupBy(*block).applyInArrow(sift, "dim int, tab int, code int, b0 int, b1 int, own int, id long")
    near = stored(near, "near", large)
    found = stored(
        near.join(coded.drop("signature"), "id").groupBy(*block).applyInArrow(compare, "id long, links long, root long"),
        "links", near, coded,
    )
    labels = connected_components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    linked = classes.select("id", "h", "g", "n", "low").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = linked.groupBy("label").agg(F.min("low").alias("component_id"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    result = linked.join(least, "label").join(links, "id", "left").select("h", "g", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    result = stored(result, "classes", classes, labels, found)
    return rows.select("vec_id", "h", "g").join(result, ["h", "g"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("h").isNull() & F.col("vec_id").isNotNull() | (F.col("vec_id") == F.col("component_id")), F.lit(False)).alias("kept"),
    )
