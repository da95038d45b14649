"""Mixing of sources to target weights by iterative proportional fitting, in DataFrame operations alone.

Tokens are summed by cell (source, language, topic). The cells' weights are
raked: scaled to the target of each margin in turn, never beyond the tokens
that a cell has, until all margins hold. A document is kept with the
probability (weight / tokens) of its cell, decided by a hash.

Topics come from a spherical k-means over hashed words, fitted on all texts:
every word stands for the topic in which it weighs most, and a document has the
topic for which most of its words stand.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, free_names, quoted, stored

#: Cells up to this number are broadcast (about 100 bytes each) and raked in one partition; beyond it both are shuffled.
SMALL_CELLS = 50_000
DIMENSIONS = ("source", "lang", "topic")
CELL = ("d0", "d1", "d2")
#: Buckets that words are hashed to for the topics, and the letters of the words that count.
TERMS, LONG = 512, 6
#: Share of a category's tokens that its target asks for at most. At its bounds raking would settle slowly; with room it takes a few blocks.
MOST = 0.8


def _words(text: Column) -> Column:
    """Runs of characters between blanks, tabs and line ends; empty ones among them."""
    blank = F.lit(" ")
    return F.split(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), blank), F.lit("\t"), blank), " ")


def _term(word: Column) -> Column:
    return F.pmod(F.crc32(word), F.lit(TERMS)).cast("int")


def _terms(words: Column) -> Column:
    """The terms of the words that have ``LONG`` letters or more, as often as they are there."""
    return F.transform(F.filter(words, lambda w: F.length(w) >= LONG), _term)


def _whole(x: Column) -> Column:
    """The nearest whole number. ``round`` goes by way of decimal digits, which takes most of the time of a sum."""
    return F.floor(x + F.lit(0.5)).cast("long")


#: Sums of fractions go as whole numbers of this part, so that they do not depend on the order of the rows.
PART = 1 << 30


def _listed(values: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


#: Two scores go in one whole number, each in 32 bits of it, as multiples of 1 / SCORE: a sum over a text's terms stays below sqrt(TERMS) x log(texts), so it fits.
SCORE = 1 << 20


def _pair_sums(held: DataFrame, lists: list[list[float]]) -> tuple[DataFrame, list[Column]]:
    """For each list of numbers by term its sum over a text's terms, two lists in a pass: the rows with the sums as they are packed, and how to read these."""
    out, names = [], free_names(held.columns, *[f"both{k}" for k in range(0, len(lists), 2)])
    for k, name in enumerate(names):
        pair = [*lists[2 * k : 2 * k + 2], [0.0] * TERMS]
        values = F.from_json(F.lit(json.dumps([(round(x * SCORE) << 32) + round(y * SCORE) for x, y in zip(*pair[:2])])), "array<bigint>")
        held = held.withColumn(name, F.aggregate("terms", F.lit(0).cast("long"), lambda sum_, t: sum_ + F.get(values, t)))  # noqa: B023
        out += [F.shiftright(F.col(name) + (1 << 31), 32) / float(SCORE), F.shiftright(F.shiftleft(name, 32), 32) / float(SCORE)]
    return held, out[: len(lists)]


def _keyed(text: Column, lang: Column) -> list[Column]:
    """What topics are fitted on besides the terms: a hash of the text and the language."""
    return [F.xxhash64(F.lit(91), text).alias("id"), F.coalesce(lang.cast("string"), F.lit("")).alias("lang")]


def fit_topics(docs: DataFrame, topics: int = 8, sweeps: int = 3) -> list[str]:
    """For each bucket of terms (words of ``LONG`` or more characters) the topic that it stands for, from all texts.

    Spherical k-means: a text is the unit vector of the inverse text frequencies
    of its terms, less the mean of its language, so topics do not repeat the
    languages; copies count as often as they are there. Starts are the texts of
    least hash; a bucket that no centre holds stands for none (an empty string).
    The terms of the texts are stored once, and each sweep is a pass over them.
    What comes to the driver is ``topics`` x ``TERMS`` numbers.
    """
    text = F.col("text").cast("string")
    held = stored(docs.select(*_keyed(text, F.col("lang")), F.array_distinct(_terms(_words(text))).alias("terms")).where(F.size("terms") > 0), "terms")
    found = _fit(held, topics, sweeps)
    drop(held)
    return found


def _fit(held: DataFrame, topics: int, sweeps: int) -> list[str]:
    """The same from ``id``, ``lang`` and ``terms`` (each once) of the texts that have terms."""
    if not 1 <= topics <= 26:
        raise ValueError("topics are letters: 1 to 26 of them")
    texts = held.count()
    if not texts:
        return [""] * TERMS
    times = {r.term: r.n for r in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}  # TERMS rows at most
    rare = [math.log((1 + texts) / times.get(t, texts)) for t in range(TERMS)]
    added = lambda values: F.aggregate("terms", F.lit(0.0), lambda sum_, t: sum_ + F.get(_listed(values), t))
    held_ = held.withColumn("norm", F.sqrt(added([x * x for x in rare])))

    def sums(placed: DataFrame) -> DataFrame:
        """(topic, lang, term, x) in parts; the term ``TERMS`` counts the texts."""
        x = F.when(F.col("term") == TERMS, F.lit(PART).cast("long")).otherwise(_whole(F.get(_listed(rare), F.col("term")) / F.col("norm") * PART))
        spread = placed.select("topic", "lang", "norm", F.explode(F.concat("terms", F.array(F.lit(TERMS)))).alias("term"))
        return stored(spread.groupBy("topic", "lang", "term").agg(F.sum(x).alias("x")), "sums")

    def counts(table: DataFrame) -> DataFrame:
        return table.where(F.col("term") == TERMS).select("topic", "lang", F.col("x").alias("n"))

    whole = sums(held_.withColumn("topic", F.lit(0)))
    means = stored(whole.where(F.col("term") < TERMS).join(counts(whole), ["topic", "lang"]).select("lang", "term", (F.col("x") / F.col("n")).alias("mean")), "means", whole)

    def centres(placed: DataFrame) -> dict[int, list[float]]:
        """The unit vectors of the sums of each topic's texts, less the means of their languages."""
        table, out = sums(placed), {}
        less = counts(table).join(means, "lang").groupBy("topic", "term").agg(F.sum(F.round(-F.col("n") * F.col("mean")).cast("long")).alias("x"))
        for r in table.where(F.col("term") < TERMS).select("topic", "term", "x").unionByName(less).groupBy("topic", "term").agg(F.sum("x").alias("x")).orderBy("topic", "term").collect():
            out.setdefault(r.topic, [0.0] * TERMS)[r.term] = float(r.x)
        drop(table)
        return {k: [x / size for x in v] for k, v in out.items() if (size := math.sqrt(sum(x * x for x in v)))}

    first = held.select("id").distinct().orderBy("id").limit(topics).select("id", (F.row_number().over(Window.orderBy("id")) - 1).alias("topic"))
    found = centres(held_.join(F.broadcast(first), "id").dropDuplicates(["id"]))
    for _ in range(sweeps):
        if not found:
            break
        shifts = [F.sum(F.round(F.col("mean") * F.get(_listed(c), F.col("term")) * PART).cast("long")).alias(f"o{k}") for k, c in found.items()]
        near = held_.join(means.groupBy("lang").agg(*shifts), "lang")
        near, sums_of = _pair_sums(near, [[w * x for w, x in zip(c, rare)] for c in found.values()])
        scores = [F.struct((s / F.col("norm") - F.col(f"o{k}") / PART).alias("s"), F.lit(-k).alias("k")) for s, k in zip(sums_of, found)]
        found = centres(near.withColumn("topic", -(F.array_max(F.array(*scores))["k"])))
    drop(means)
    best = [max(((c[t], -k) for k, c in found.items() if c[t] > 0), default=None) for t in range(TERMS)]
    return [chr(97 - b[1]) if b else "" for b in best]


def topic_of(words: Column, table: list[str]) -> Column:
    """The topic for which most of a text's terms stand, the first of several; null for a text without terms that stand for one."""
    return _topic(_terms(words), table)


def _topic(terms: Column, table: list[str]) -> Column:
    letters = F.from_json(F.lit(json.dumps(table)), "array<string>")
    told = F.array_join(F.transform(terms, lambda t: F.get(letters, t)), "")
    names = sorted({t for t in table if t})
    if not names:
        return F.lit(None).cast("string")
    # The count of each letter: the length that goes when it is taken out.
    return F.aggregate(F.array(told), F.lit(None).cast("string"), lambda none, s: F.when(s != "", F.array_max(F.array(*[F.struct((F.length(s) - F.length(F.replace(s, F.lit(t), F.lit("")))).alias("n"), F.lit(-ord(t)).alias("o"), F.lit(t).alias("t")) for t in names]))["t"]))


def _category(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))  # names ``c`` once, so a topic is worked out once


def measured(docs: DataFrame, topic: Column | None, seed: int, columns: list[str]) -> DataFrame:
    """A stored table of ``row`` (struct of ``columns``), ``tokens``, ``unit`` (a number from 0 to 1 by a hash of doc_id and text) and the cell ``d0`` (source), ``d1`` (language), ``d2`` (topic).

    A token is a run of characters between blanks, tabs and line ends; a text
    has one at least. A null source, language or topic is a category of its
    own, ``-``; others stand behind ``=``. Without a ``topic`` there are in
    place of ``d2`` the ``id``, ``lang`` and ``terms`` of the text and its
    different ``kinds`` of terms, so the texts are split once for all.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.struct(*map(quoted, columns)).alias("row"), _category(F.col("source")).alias("d0"), _category(F.col("lang")).alias("d1"),
        *([_category(topic).alias("d2")] if topic is not None else _keyed(text, F.col("lang"))), _words(text).alias("words"),
        (F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)).alias("unit"),
    )
    terms = {"terms": _terms(F.col("words"))} if topic is None else {}
    rows = rows.withColumns({"tokens": F.greatest(F.lit(1), F.size(F.array_remove("words", ""))).cast("long"), **terms}).drop("words")
    if topic is None:
        rows = rows.withColumn("kinds", F.array_distinct("terms"))
    return stored(rows, "measured")


def _feasible(margin: DataFrame, wanted: float, bound: float) -> DataFrame:
    """Adds ``target`` to the categories (``tokens``, ``share``): ``wanted`` tokens in proportion to the shares, none beyond ``bound`` of its own tokens; what such a category can't take goes to the others.

    Each round finds all categories that are over their tokens, so rounds are
    few; every round is one small sum.
    """
    scale, most = 0.0, F.col("tokens") * F.lit(bound)
    while True:
        full = F.col("share") * F.lit(scale) >= most
        held, left = margin.agg(F.coalesce(F.sum(F.when(full, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("share"))), F.lit(0.0))).first()
        new = (wanted - held) / left if left > 0 else scale
        if new <= scale * (1 + 1e-12):
            return margin.withColumn("target", F.least(most, F.col("share") * F.lit(scale)))
        scale = new


def rake(cells: DataFrame, keep: float, sharpness: float, targets: dict[str, dict[str, float]] | None = None, blocks: int = 400) -> DataFrame:
    """Adds ``t0``..``t2``, the targets of a cell's categories, and ``weight`` to the cells (``d0``..``d2``, ``tokens``): iterative proportional fitting with upper bounds.

    The target of a category is its share of the tokens to the power
    ``sharpness``, or the share that ``targets`` names for it (a category not
    named gets none), made to sum to ``keep`` times all tokens; one that would
    need more than ``MOST`` of its tokens gets that (more only if ``keep`` is
    more), and the others the rest.
    Four sweeps over the margins are one plan; sweeps go on until no weight
    moves by a ten-millionth of its cell, and raise if ``blocks`` of four do not
    settle them. Where the cells' bounds still keep a margin from its targets,
    ``residuals`` tells by how much.
    """
    n, total = cells.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    work = cells.coalesce(1) if n <= SMALL_CELLS else cells
    for k, name in enumerate(DIMENSIONS):
        d, own = CELL[k], (targets or {}).get(name)
        margin = cells.groupBy(d).agg(F.sum("tokens").alias("tokens"))
        if own:
            table = F.create_map(*[F.lit(x) for c, w in own.items() for x in ("=" + c, float(w))])
            margin = margin.withColumn("share", F.coalesce(F.try_element_at(table, F.col(d)), F.lit(0.0)))
        else:
            margin = margin.withColumn("share", F.pow(F.col("tokens") / F.lit(max(1, total)), F.lit(float(sharpness))))
        margin = stored(margin, "margin")
        work = work.join(_feasible(margin, keep * total, max(MOST, keep)).select(d, F.col("target").alias(f"t{k}")), d)
    work = stored(work.withColumn("weight", F.col("tokens") * F.lit(float(keep))), "cells")
    for _ in range(blocks):
        before = work
        work = work.coalesce(1) if n <= SMALL_CELLS else work
        work = work.withColumn("old", F.col("weight"))  # replaces that of the block before
        for k in [0, 1, 2] * 4:
            inside = F.sum("weight").over(Window.partitionBy(CELL[k]))
            work = work.withColumn("weight", F.when(inside > 0, F.least(F.col("tokens").cast("double"), F.col("weight") * F.col(f"t{k}") / inside)).otherwise(F.lit(0.0)))
        work = stored(work, "cells", before)
        moved = work.agg(F.max(F.abs(F.col("weight") - F.col("old")) / F.col("tokens"))).first()[0]
        if moved is None or moved < 1e-7:
            return work.drop("old")
    raise RuntimeError(f"raking moves weights by {moved:.1e} of their cells after {blocks} blocks of four sweeps")


def residuals(raked: DataFrame) -> DataFrame:
    """For each category of each margin its target, the weight reached and the difference as a share of all weight."""
    whole = F.sum("weight").over(Window.partitionBy())
    out = None
    for k, name in enumerate(DIMENSIONS):
        part = raked.groupBy(F.col(CELL[k]).alias("category")).agg(F.first(f"t{k}").alias("target"), F.sum("weight").alias("weight"))
        part = part.select(F.lit(name).alias("margin"), "category", "target", "weight", ((F.col("weight") - F.col("target")) / whole).alias("residual"))
        out = part if out is None else out.unionByName(part)
    return out


def mix_documents(docs: DataFrame, keep: float = 0.5, sharpness: float = 0.7, targets: dict[str, dict[str, float]] | None = None, topics: int = 8, topic: Column | None = None, seed: int = 17, columns: list[str] | None = None) -> DataFrame:
    """Samples documents so that source, language and topic come near target shares of the tokens.

    ``docs`` needs doc_id, text, lang and source. Returns the documents that
    are kept, their ``columns`` (default: all, whatever their names), with
    ``__d0``..``__d2``, ``__tokens`` and ``__probability``; these get more
    underscores where ``docs`` has such columns. 1 / probability is the weight
    that makes the sample stand for the corpus. ``targets`` may name shares for
    "source", "lang" and "topic"; otherwise shares are flattened to the power
    ``sharpness``. The topic is ``topic`` if given, else one of ``topics`` that
    ``fit_topics`` finds.

    The decision hashes doc_id and text, so it is the same in any run, and rows
    alike in both are kept or dropped together. Null text: one token. Null
    doc_id: the text alone decides. An empty table gives an empty result.
    """
    columns = columns or docs.columns
    rows = measured(docs, topic, seed, columns)
    if topic is None:
        table = _fit(rows.where(F.size("kinds") > 0).select("id", "lang", F.col("kinds").alias("terms")), topics, 3)
        rows = rows.withColumn("d2", _category(_topic(F.col("terms"), table))).drop("id", "lang", "terms", "kinds")
    cells = stored(rows.groupBy(*CELL).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "cells")
    small = cells.count() <= SMALL_CELLS
    raked = rake(cells, keep, sharpness, targets).select(*CELL, (F.col("weight") / F.col("tokens")).alias("probability"))
    if small:
        joined = rows.join(F.broadcast(raked), list(CELL))
    else:  # a hot cell is spread over salts
        salts = 32
        raked = raked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("salt", F.floor(F.col("unit") * (1 << 20)).cast("int") % salts).join(raked, [*CELL, "salt"])
    added = free_names(columns, "__d0", "__d1", "__d2", "__tokens", "__probability")
    return joined.where("unit < probability").select("row.*", *[F.col(c).alias(name) for c, name in zip((*CELL, "tokens", "probability"), added)])
