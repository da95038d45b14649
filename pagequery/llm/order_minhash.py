"""Near-duplicate documents by Order MinHash and banded alignment.

Order MinHash (Marcais, DeBlasio, Pandey and Kingsford, 2019): k-mers of words
are labelled with their occurrence, each sketch takes the few of least hash and
keeps them in the order of the text, so it agrees with a probability that
follows edit similarity. Documents that share a sketch are candidates; an
alignment inside a band decides.

Equal texts are one class first. The sketches travel as packed numbers, dealt by
key, and only buckets of several texts go on. Each bucket's members are held
against the least of them and components are formed; where a bucket still spans
several, the others are held against one of its largest, another in each bucket.
Only what is apart after that is compared pair by pair, across components alone
and in blocks. So large groups of copies cost few comparisons a member, and
still no candidate pair of different components goes unverified.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .components import connected_components
from .scratch import drop, free_names, quoted, stored
from .token_file import batches

_WORD = re.compile(r"\w+")
#: Texts of at most this many words have sketches of 2-word k-mers; texts of more than ``threshold`` times it have those of k words (so any two that may be alike share a kind).
SHORT = 60
#: Members of a bucket in a block of the second pass.
BLOCK = 512
BITS = 4096
#: A sketch of a text on its way: bucket, text, words of the text, places of the two k-mers in 256ths of the text.
ENTRY = np.dtype([("key", "<i8"), ("h", "<i8"), ("n", "<i4"), ("first", "u1"), ("second", "u1")])
#: Bytes of entries that a task holds before it sends them, and that meet in a group on average.
SENT, MET = 32 << 20, 16 << 20


class WordHashes:
    """64-bit hashes of words, the same in every process; a bounded number is remembered."""

    def __init__(self, cap: int = 500_000):
        self.known: dict[str, int] = {}
        self.cap = cap

    def __call__(self, words: list[str]) -> np.ndarray:
        got = list(map(self.known.get, words))
        if None in got:
            if len(self.known) > self.cap:
                self.known.clear()
                got = [None] * len(words)
            for w in {w for w, h in zip(words, got) if h is None}:
                self.known[w] = xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            got = list(map(self.known.get, words))
        return np.array(got, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finishing steps of splitmix64, a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def labelled_kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-mer of words with its occurrence number in the text; a shorter text is one k-mer."""
    n = max(1, len(words) - k + 1)
    value = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        value = _mixed(value * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    order = np.argsort(value, kind="stable")
    inorder = value[order]
    new = np.concatenate([[True], inorder[1:] != inorder[:-1]])
    if not new.all():
        starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        occurrence = np.empty(n, np.uint64)
        occurrence[order] = np.arange(n) - starts
        value = np.where(occurrence > 0, _mixed(value + occurrence * np.uint64(0xD1B54A32D192ED03)), value)  # a first one is the same whether or not others follow
    return value


@lru_cache(maxsize=8)
def _hashers(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return tuple(r.integers(0, 2**63, (count, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def sketches(kmers: np.ndarray, count: int, seed: int = 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each sketch its key and the places in the text of its two k-mers of least hash; a text of one k-mer takes it twice."""
    salts, odds = _hashers(count, seed)
    one, two = np.zeros(count, np.int64), np.zeros(count, np.int64)
    if len(kmers) > 1:
        step = max(1, (1 << 19) // len(kmers))  # sketches at once, so that long texts take no more memory
        for j in range(0, count, step):
            h = (kmers ^ salts[j : j + step]) * odds[j : j + step]
            one[j : j + step] = h.argmin(axis=1)
            h[np.arange(len(h)), one[j : j + step]] = np.uint64(2**64 - 1)
            two[j : j + step] = h.argmin(axis=1)
    first, second = np.minimum(one, two), np.maximum(one, two)
    return _mixed(kmers[first] * np.uint64(3) + _mixed(kmers[second] + salts[:, 0])).view(np.int64), first, second


def sketches_needed(threshold: float, k: int, miss: float) -> int:
    """Sketches of two k-mers by which a pair at ``threshold``, its edits at random places of a long text, is missed with probability ``miss``."""
    alive = threshold**k  # share of k-mers that no edit touches
    return max(1, math.ceil(math.log(miss) / math.log1p(-min((alive / (2 - alive)) ** 2, 1 - 1e-9))))


def all_sketches(words: np.ndarray, threshold: float, k: int, count: int) -> tuple[np.ndarray, ...]:
    """Keys and places of the sketches of a text, of one kind or, near the limit, both."""
    kinds = [sketches(labelled_kmers(words, k), count)] if len(words) > threshold * SHORT else []
    kinds += [sketches(labelled_kmers(words, min(k, 2)), count, 37)] if len(words) <= SHORT else []
    return tuple(np.concatenate(parts) for parts in zip(*kinds))


def word_bits(words: np.ndarray) -> np.ndarray:
    """The words, each with its occurrence number, hashed to ``BITS`` bits. A word more than the other text has costs an edit, so a bit that the other lacks does."""
    seen = np.zeros(BITS, bool)
    seen[labelled_kmers(words, 1) >> np.uint64(64 - BITS.bit_length() + 1)] = True
    return np.packbits(seen).view(np.int64)


def _band(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance if it is at most ``most``, else something above. ``b`` is the longer by no more than ``most``.

    Only cells within ``most`` of the diagonal are computed, a column of the
    band at a time as the bits of integers (Myers, 1999; Hyyro, 2003). Bit i of
    column j stands for row j - most + i.
    """
    where: dict[int, int] = {}
    for i, w in enumerate(a.tolist(), most):
        where[w] = where.get(w, 0) | 1 << i
    rows, top = len(a), 2 * most
    full = (2 << top) - 1
    rise, fall = full ^ ((1 << most) - 1), 0  # rows whose value is one above, one below the row before
    distance = min(most, rows)  # of the last row of the band
    for j, w in enumerate(b.tolist(), 1):
        match = where.get(w, 0) >> (j - 1) & full
        level = ((((match & rise) + rise) ^ rise) | match | fall) & full  # no cost along the diagonal
        up, down = fall | (full ^ (level | rise)), level & rise  # steps from the column before
        if j + most <= rows:
            distance += not level >> top
        else:
            bit = rows - j + most
            distance += (up >> bit & 1) - (down >> bit & 1)
        rise, fall = down | (full ^ ((level >> 1 | up) & full)), level >> 1 & up
    return distance


def bounded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two word sequences if it is at most ``most``, else ``most + 1``. The band widens until it holds the distance, so close texts are quick however long."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    differs = np.flatnonzero(a != b[: len(a)])
    head = int(differs[0]) if len(differs) else len(a)
    a, b = a[head:], b[head:]
    differs = np.flatnonzero(a[::-1] != b[len(b) - len(a) :][::-1])
    tail = int(differs[0]) if len(differs) else len(a)
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a):
        return len(b)
    lacks = int(max((~np.isin(a, b)).sum(), (~np.isin(b, a)).sum()))
    if lacks > most:
        return most + 1  # words that the other lacks cost an edit each
    band = max(16, len(b) - len(a), 2 * lacks)
    while True:
        band = min(band, most)
        found = _band(a, b, band)
        if found <= band or band == most:
            return min(found, most + 1)
        band *= 8


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether 1 - (edits / words of the longer) is ``threshold`` or more."""
    most = int((1 - threshold) * max(len(a), len(b)) + 1e-9)
    return bounded_distance(a, b, most) <= most


_TEXTS = pa.schema([("doc_id", pa.int64()), ("sig1", pa.int64()), ("sig2", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("n", pa.int32()), ("words", pa.binary())])


def _signed(docs: DataFrame, names: list[str]) -> DataFrame:
    """Adds two hashes of all columns, called ``names``, by which rows are found again."""
    columns = [F.to_json(quoted(c)) if kind.startswith(("map", "variant")) else quoted(c) for c, kind in docs.dtypes]
    return docs.select("*", F.xxhash64(*columns).alias(names[0]), F.xxhash64(F.lit(41), *columns).alias(names[1]))


def _texts(docs: DataFrame) -> DataFrame:
    """Fingerprint (h, g) of the words, their number and hashes. A copy that the same task has met lacks the hashes."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, met = WordHashes(), set()

        def one(text: str | None):
            if text is None:
                return None, None, 0, None
            words = _WORD.findall(text.lower())
            whole = " ".join(words) if words else "\0" + text
            h, g = struct.unpack("<qq", blake2b(whole.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            if not words or (h, g) in met:
                return h, g, len(words), None
            if len(met) > 200_000:
                met.clear()
            met.add((h, g))
            return h, g, len(words), hashes(words).astype("<u4").tobytes()

        def rows():
            for part in parts:
                for doc_id, sig1, sig2, text in zip(*(c.to_pylist() for c in part.columns)):
                    yield doc_id, sig1, sig2, *one(text)

        yield from batches(rows(), _TEXTS, lambda row: len(row[6] or b"") + 48)

    sigs = free_names(docs.columns, "__sig1", "__sig2")
    own = _signed(docs, sigs).select(F.col("doc_id").cast("long"), *sigs, F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, sig1 long, sig2 long, h long, g long, n int, words binary")


def entries_of(h: int, words: np.ndarray, threshold: float, k: int, count: int) -> np.ndarray:
    """The sketches of a text as ``ENTRY``."""
    key, first, second = all_sketches(words.astype(np.uint64), threshold, k, count)
    out = np.empty(len(key), ENTRY)
    out["key"], out["h"], out["n"] = key, h, len(words)
    out["first"], out["second"] = first * 256 // len(words), second * 256 // len(words)
    return out


def fits(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether an alignment through the two k-mers that sketches share can be inside the band; the places' rounding counts for it."""
    x, y = ({"n": e["n"].astype(float), "first": (e["first"] + 0.5) * e["n"] / 256, "second": (e["second"] + 0.5) * e["n"] / 256} for e in (a, b))
    off = np.abs(x["first"] - y["first"]) + np.abs(x["second"] - x["first"] - y["second"] + y["first"]) + np.abs(x["n"] - x["second"] - y["n"] + y["second"])
    return (off <= (1 - threshold) * np.maximum(x["n"], y["n"]) + (x["n"] + y["n"]) / 128 + 1e-9) & (np.minimum(x["n"], y["n"]) >= threshold * np.maximum(x["n"], y["n"]) - 1e-9)


def _fits(a: str, b: str, threshold: float) -> str:
    """The same in SQL."""
    first, second = (lambda t, place=place: f"(({t}.{place} + 0.5) * {t}.n / 256)" for place in ("first", "second"))
    return (
        f"least({a}.n, {b}.n) >= {threshold!r} * greatest({a}.n, {b}.n) - 1e-9 AND"
        f" abs({first(a)} - {first(b)}) + abs({second(a)} - {first(a)} - {second(b)} + {first(b)}) + abs({a}.n - {second(a)} - {b}.n + {second(b)})"
        f" <= {1 - threshold!r} * greatest({a}.n, {b}.n) + ({a}.n + {b}.n) / 128 + 1e-9"
    )


def led(entries: np.ndarray, leads: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The entries of buckets of several texts, in order, each with the least of its bucket.

    ``leads`` (in order of key) names them instead; then all entries are of such buckets.
    """
    entries = entries[np.lexsort((entries["h"], entries["key"]))]
    entries = entries[np.append(True, (entries["key"][1:] != entries["key"][:-1]) | (entries["h"][1:] != entries["h"][:-1]))] if len(entries) else entries
    if leads is not None:
        return entries, leads[np.searchsorted(leads["key"], entries["key"])]
    new = np.flatnonzero(np.append(True, entries["key"][1:] != entries["key"][:-1])) if len(entries) else np.zeros(0, np.int64)
    size = np.diff(np.append(new, len(entries)))
    lead = np.repeat(new, size)
    several = np.repeat(size, size) > 1
    return entries[several], entries[lead[several]]


def _hot_leads(sketched: DataFrame, rows: int, hot_rows: int, make) -> np.ndarray:
    """An entry for each key that some ``hot_rows`` texts share, from a sample in which such a key shows about 32 times and counts from 16 on.

    At most rows x sketches / (hot_rows / 2) entries of 22 bytes come to the
    driver: 150 MB for 5 x 10^10 texts. Tables below ``hot_rows`` have none.
    """
    if rows <= hot_rows:
        return np.zeros(0, ENTRY)
    drawn = sketched.where(F.pmod(F.xxhash64("h", "g", F.lit(77)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, 32 / hot_rows)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for h, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                e = make(h, words)
                yield pa.RecordBatch.from_arrays([pa.array(e["key"]), pa.array([h] * len(e), pa.int64()), pa.array([x.tobytes() for x in e], pa.binary())], names=["key", "h", "data"])

    seen = drawn.select("h", "words").mapInArrow(run, "key long, h long, data binary").groupBy("key").agg(F.count_distinct("h").alias("times"), F.min("data").alias("data")).where("times >= 16")
    found = np.frombuffer(b"".join(bytes(r.data) for r in seen.select("data").collect()), ENTRY)
    return found[np.argsort(found["key"])]


def _members(sketched: DataFrame, rows: int, threshold: float, k: int, miss: float, hot_rows: int) -> DataFrame:
    """Buckets of several texts: key, h, n, first, second and lead, the text to be compared with (null where none can be).

    Entries are dealt by key and packed, so a task sends a row for each group,
    not for each sketch. Buckets that a sample shows to be hot are not gathered
    at all: their leads are known everywhere.
    """
    count = sketches_needed(threshold, k, miss)
    groups = max(64, -(-rows * count * ENTRY.itemsize // MET))

    def make(h: int, words: bytes) -> np.ndarray:
        return entries_of(h, np.frombuffer(words, "<u4"), threshold, k, count)

    leads = sketched.sparkSession.sparkContext.broadcast(_hot_leads(sketched, rows, hot_rows, make))

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        hot = leads.value["key"]

        def flush():
            own = np.concatenate(held)
            held.clear()
            bag = ((own["key"].view(np.uint64) >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)
            if len(hot):
                near = np.minimum(np.searchsorted(hot, own["key"]), len(hot) - 1)
                bag = np.where(hot[near] == own["key"], -1 - own["h"] % groups, bag)
            order = np.argsort(bag, kind="stable")
            own, bag = own[order], bag[order]
            starts = np.flatnonzero(np.append(True, bag[1:] != bag[:-1]))
            ends = np.append(starts[1:], len(bag))
            yield from batches(((int(bag[a]), own[a:b].tobytes()) for a, b in zip(starts, ends)), pa.schema([("bag", pa.int64()), ("data", pa.binary())]), lambda row: len(row[1]))

        size = 0
        for part in parts:
            for h, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                held.append(make(h, words))
                size += held[-1].nbytes
                if size > SENT:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        entries = np.frombuffer(b"".join(table.column("data").to_pylist()), ENTRY)
        own, lead = led(entries, leads.value if key[0].as_py() < 0 else None)
        alone = (own["h"] == lead["h"]) | ~fits(own, lead, threshold)
        return pa.table({"key": own["key"], "h": own["h"], "n": own["n"], "first": own["first"].astype(np.int16), "second": own["second"].astype(np.int16), "lead": pa.array(lead["h"], mask=alone)})

    sent = sketched.select("h", "words").mapInArrow(send, "bag long, data binary")
    return stored(sent.groupBy("bag").applyInArrow(meet, "key long, h long, n int, first short, second short, lead long"), "buckets")


def _marked(rows: DataFrame, wanted: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """Adds whether a row's keys are perhaps in ``wanted``: never false for one that is. A filter of 512 bitmaps of 4 KB each, whatever the number of rows."""
    spot = F.pmod(F.xxhash64(*map(quoted, keys)), F.lit(512 * 32768))
    bucket, bit, bits = free_names(rows.columns, "__map", "__bit", "__bits")
    maps = wanted.select(F.bitmap_bucket_number(spot).alias(bucket), F.bitmap_bit_position(spot).alias(bit)).groupBy(bucket).agg(F.bitmap_construct_agg(bit).alias(bits))
    joined = rows.withColumns({bucket: F.bitmap_bucket_number(spot), bit: F.bitmap_bit_position(spot)}).join(F.broadcast(maps), bucket, "left")
    found = F.expr(f"cast(conv(hex(substring({bits}, cast({bit} div 8 as int) + 1, 1)), 16, 10) as int) >> cast({bit} % 8 as int) & 1")
    return joined.withColumn(mark, F.coalesce(found == 1, F.lit(False))).drop(bucket, bit, bits)


def _held(sketched: DataFrame, heads: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, h and words of the texts whose h is in ``wanted``, and a few others: keeps most texts that no pair needs out of the shuffle."""
    near = _marked(sketched.select("row", "h", "words"), wanted, ["h"], "__perhaps").where("__perhaps").select(F.col("row").alias("id"), "h", "words")
    return stored(near.join(heads.select("id"), "id", "left_semi"), "words")


def _verified(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b) of h those that an alignment confirms, as ids src and dst."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            a, b, x, y = (part.column(k) for k in range(4))
            good = [similar(np.frombuffer(p.as_buffer(), "<u4"), np.frombuffer(q.as_buffer(), "<u4"), threshold) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([a, b], names=["src", "dst"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(held.select(F.col("h").alias("a"), F.col("id").alias("src"), F.col("words").alias("x")), "a")
    joined = joined.join(held.select(F.col("h").alias("b"), F.col("id").alias("dst"), F.col("words").alias("y")), "b").where("src <> dst")
    return stored(joined.select("src", "dst", "x", "y").mapInArrow(run, "src long, dst long"), "edges")


def _named(members: DataFrame, heads: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of the buckets with id and label."""
    ids = heads.select("h", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("h", "id", F.coalesce("label", "id").alias("label"))
    return stored(members.select("key", "h", "n", "first", "second").join(ids, "h"), "named")


def _parts(named: DataFrame) -> DataFrame:
    """The components of each bucket: key, label, count and lead, one of the members, chosen by a hash of text and bucket."""
    return stored(named.groupBy("key", "label").agg(F.count("*").alias("count"), F.min_by(F.struct("h", "n", "first", "second"), F.xxhash64("h", "key")).alias("lead")), "parts")


def _still_open(named: DataFrame, parts: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of the buckets that span several components by the newer ``labels``, with these. Which buckets do is told by their components, so the members of the others are not gone through."""
    newer = labels.select(F.col("node").alias("label"), F.col("label").alias("now"))
    spread = parts.select("key", "label").join(newer, "label", "left").groupBy("key").agg(F.min(F.coalesce("now", "label")).alias("low"), F.max(F.coalesce("now", "label")).alias("high"))
    several = stored(spread.where("low < high").select("key"), "several", parts)  # a table, so that the join can split a hot key
    left = stored(named.join(several, "key", "left_semi"), "open", named, several)
    return stored(left.join(newer, "label", "left").withColumn("label", F.coalesce("now", "label")).drop("now"), "open", left)


def _sided(open_: DataFrame) -> DataFrame:
    """Adds to the members whether they are ``inside`` the largest component of their bucket, and the blocks of both sides."""
    main = open_.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.max("count").alias("most"), F.sum("count").alias("all"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = stored(main.select("key", "main", blocks(F.col("most")).alias("large"), blocks(F.col("all") - F.col("most")).alias("small")), "sizes")
    return stored(open_.join(sizes, "key").withColumn("inside", F.col("label") == F.col("main")).drop("main"), "sided", open_, sizes)


def _against_main(named: DataFrame, threshold: float, parts: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of h: each member outside the largest component of its bucket with one inside, chosen by a hash of text and bucket, so that many are met over all buckets.

    Only such pairs come out of the join: neither the members of the largest
    component nor those of buckets of one component. ``parts`` are the buckets'
    components, if they are known.
    """
    best = F.max_by(F.struct("label", "lead"), F.struct("count", "label")).alias("main")
    leads = (parts or _parts(named)).groupBy("key").agg(best, F.count("*").alias("parts")).where("parts > 1")
    leads = stored(leads.select("key", F.col("main.label").alias("main"), "main.lead"), "leads")
    met = named.alias("m").join(leads, "key").where("label <> main").where(_fits("lead", "m", threshold))
    return met.select(F.least("m.h", "lead.h").alias("a"), F.greatest("m.h", "lead.h").alias("b")).distinct()


def _bits(held: DataFrame) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            bits = [word_bits(np.frombuffer(x.as_buffer(), "<u4").astype(np.uint64)).tobytes() for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits, pa.binary())], names=["id", "bits"])

    return held.select("id", "words").mapInArrow(run, "id long, bits binary")


def pairs_within(starts: np.ndarray, sizes: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i before j, of all pairs of rows inside each of some groups that lie one behind another; about ``most`` pairs at a time."""
    first = np.repeat(starts + sizes, sizes)  # the end of each row's group
    rows = np.arange(int(sizes.sum())) + (starts[0] if len(starts) else 0)
    after = first - rows - 1
    at, total = 0, np.concatenate([[0], np.cumsum(after)])
    while at < len(rows):
        upto = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        n = after[at:upto]
        i = np.repeat(rows[at:upto], n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        at = upto


def alike_pairs(block: dict[str, np.ndarray], keys: list[np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of members that share a block, are of different components, and may be alike by size, places and words; each pair only in the least bucket that both share.

    ``block`` holds columns in order of (key, kind, b0, b1). Kind 0 is of
    members inside the largest component and others, which pair across; in
    kind 1 two blocks pair across, one with itself.
    """
    names = ("key", "kind", "b0", "b1")
    new = np.flatnonzero(np.append(True, np.any([block[c][1:] != block[c][:-1] for c in names], axis=0)))
    for i, j in pairs_within(new, np.diff(np.append(new, len(block["key"])))):
        take = (block["label"][i] != block["label"][j]) & np.where(block["kind"][i] == 0, block["inside"][i] != block["inside"][j], (block["own"][i] != block["own"][j]) | (block["b0"][i] == block["b1"][i]))
        i, j = i[take], j[take]
        take = fits({c: block[c][i] for c in ("n", "first", "second")}, {c: block[c][j] for c in ("n", "first", "second")}, threshold)
        i, j = i[take], j[take]
        kept = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 14):  # a word that the other lacks costs an edit
            x, y = block["bits"][i[at : at + (1 << 14)]], block["bits"][j[at : at + (1 << 14)]]
            lacks = np.maximum(np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
            n = np.maximum(block["n"][i[at : at + len(x)]], block["n"][j[at : at + len(x)]])
            kept[at : at + len(x)] = lacks <= (1 - threshold) * n + 1e-9
        i, j = i[kept], j[kept]
        sets: dict[int, set] = {}
        least = np.zeros(len(i), bool)
        for k, (p, q) in enumerate(zip(i.tolist(), j.tolist())):
            if q not in sets:
                sets[q] = set(keys[q].tolist())
            least[k] = next(x for x in keys[p].tolist() if x in sets[q]) == block["key"][p]
        yield i[least], j[least]


def _across(sided: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of h that share a bucket and are of different components, and may be alike.

    The largest component of a bucket meets the others, and these each other,
    block by block; its own members do not meet again. Blocks are dealt by
    themselves, so a hot bucket is the work of many tasks.
    """
    rows = sided.agg(F.sum(F.when(F.col("inside"), F.col("small")).otherwise(F.col("large") + F.col("small")))).first()[0] or 0
    bags = max(64, -(-rows * 1500 // MET))
    shared = sided.groupBy("id").agg(F.array_sort(F.collect_list("key")).alias("keys"))  # no more than the sketches of a text
    mixed = sided.join(_bits(held).join(shared, "id"), "id")
    mixed = mixed.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("inside"), F.col("large")).otherwise(F.col("small"))).cast("int"))
    place = lambda kind, x, y: f"named_struct('kind', {kind}, 'b0', {x}, 'b1', {y})"
    upto = lambda n, made: f"transform(sequence(0, {n} - 1), j -> {made})"
    places = f"CASE WHEN inside THEN {upto('small', place(0, 'j', 'own'))} ELSE concat({upto('large', place(0, 'own', 'j'))}, {upto('small', place(1, 'least(own, j)', 'greatest(own, j)'))}) END"
    dealt = mixed.withColumn("place", F.explode(F.expr(places))).select("key", "place.*", "inside", "own", "h", "n", "first", "second", "label", "bits", "keys")

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("key", "kind", "b0", "b1")]).combine_chunks()
        block = {c: table.column(c).to_numpy() for c in ("key", "kind", "b0", "b1", "inside", "own", "h", "n", "first", "second", "label")}
        block["bits"] = np.frombuffer(b"".join(table.column("bits").to_pylist()), "<u8").reshape(len(table), -1)
        lists = table.column("keys").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
        found = list(alike_pairs(block, np.split(flat, ends[:-1]), threshold))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"a": np.minimum(block["h"][i], block["h"][j]), "b": np.maximum(block["h"][i], block["h"][j])})

    bag = F.pmod(F.xxhash64("key", "kind", "b0", "b1"), F.lit(bags))
    return dealt.withColumn("bag", bag).groupBy("bag").applyInArrow(meet, "a long, b long").distinct()


def _joined_up(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Components after more edges; ``labels`` go if there are others."""
    if edges.isEmpty():
        drop(edges)
        return labels
    joined = connected_components(labels.select(F.col("node").alias("src"), F.col("label").alias("dst")).union(edges))
    drop(labels, edges)
    return joined


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 4, miss: float = 1e-3, hot_rows: int = 3_000_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_rows, kept, sig1, sig2.

    ``docs`` needs doc_id and text; the other columns, whatever their names,
    only tell rows apart. Texts are compared as lower-case words. Two are
    near-duplicates if their word edit similarity is ``threshold`` or more;
    candidates are texts that share one of the sketches of two k-mers each, as
    many as leave a pair at ``threshold`` unfound with probability ``miss``. A
    class is a component of these links, class_id its least doc_id, and the row
    that has it is kept (of rows that repeat it, one). Buckets of more than
    about ``hot_rows`` texts are not gathered in one task.

    Null texts link with nothing and are kept. Texts without words, the empty
    one among them, are alike if they are equal. Texts of at most ``SHORT``
    words have k-mers of two words; a single word is one k-mer. Null doc_ids come after all others in a class; a class of
    none but null doc_ids has a null class_id. An empty table gives no rows.
    Texts are taken whole; no bucket, class or candidate list is capped.
    """
    rows = stored(_texts(docs).withColumn("row", F.monotonically_increasing_id()), "texts")
    least = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    heads = stored(rows.where("h IS NOT NULL").groupBy("h", "g").agg(F.min(least).alias("least"), F.count("*").alias("copies"), F.coalesce(F.min(F.when(F.col("words").isNotNull(), F.col("row"))), F.min("row")).alias("id")), "heads")
    sketched = rows.where("words IS NOT NULL")
    members = _members(sketched, sketched.count(), threshold, k, miss, hot_rows)
    # Each bucket's members against the least of them.
    pairs = stored(members.where("lead IS NOT NULL").select(F.least("h", "lead").alias("a"), F.greatest("h", "lead").alias("b")).distinct(), "pairs")
    held = _held(sketched, heads, pairs.select(F.explode(F.array("a", "b")).alias("h")))
    edges = _verified(pairs, held, threshold)
    labels = connected_components(edges)
    drop(held, edges)
    # The members of those that are not whole against one of the largest component.
    named = _named(members, heads, labels)
    drop(members)
    parts = _parts(named)
    more = stored(_against_main(named, threshold, parts).join(pairs, ["a", "b"], "left_anti"), "pairs")
    held = _held(sketched, heads, more.select(F.explode(F.array("a", "b")).alias("h")))
    labels = _joined_up(labels, _verified(more, held, threshold))
    drop(held)
    # All pairs across the components that a bucket still holds.
    open_ = _still_open(named, parts, labels)
    held = _held(sketched, heads, open_.select("h"))
    sided = _sided(open_)
    tried = stored(pairs.union(more), "pairs", pairs, more)
    last = stored(_across(sided, held, threshold).join(tried, ["a", "b"], "left_anti"), "pairs", tried, sided)
    labels = _joined_up(labels, _verified(last, held, threshold))
    drop(last, held)
    classed = heads.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    classes = stored(classed.groupBy("label").agg(F.min("least").alias("head"), F.sum("copies").alias("class_rows")), "heads")  # a table, so that the join can split a large class
    found = stored(classed.select("h", "g", "label").join(classes, "label").select("h", "g", F.col("head.doc_id").alias("class_id"), F.col("head.row").alias("head_row"), "class_rows"), "classes", heads, labels, classes)
    alone = F.col("h").isNull()
    result = rows.drop("words").join(found, ["h", "g"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_rows")).cast("long").alias("class_rows"),
        (alone | (F.col("row") == F.col("head_row"))).alias("kept"),
        "sig1",
        "sig2",
    )
    return stored(result, "result", rows, found)


def keep_one_of_each(docs: DataFrame, threshold: float = 0.8, k: int = 4, miss: float = 1e-3) -> DataFrame:
    """The kept rows of ``docs`` with their columns, whatever their names. Of rows alike in every column one stays, but all with a null text do.

    Only rows that share the hashes of a row that goes, or a bit of the filter
    with one, are shuffled; the others stay where they are. An empty table gives none.
    """
    sigs, mark = free_names(docs.columns, "__sig1", "__sig2"), free_names(docs.columns, "__perhaps")[0]
    found = near_duplicates(docs, threshold, k, miss).select("kept", F.col("sig1").alias(sigs[0]), F.col("sig2").alias(sigs[1]))
    marked = _marked(_signed(docs, sigs), found.where("NOT kept").select(*sigs), sigs, mark).withColumn(mark, quoted(mark) & F.col("text").isNotNull())
    unsure = marked.where(quoted(mark)).join(found.where("kept").select(*sigs).distinct(), sigs, "left_semi").dropDuplicates(sigs)
    names = [quoted(c) for c in docs.columns]
    return marked.where(~quoted(mark)).select(*names).unionByName(unsure.select(*names))
