"""Quality classifier by weak supervision.

Overlapping heuristics vote good, bad or nothing on every text. Expectation-
maximisation over the counts of all vote patterns estimates how often each
heuristic votes what, given the hidden quality (Dawid and Skene, 1979; Ratner et
al., 2016). The posteriors are the soft labels from which a linear scorer over
hashed byte trigrams is trained; it scores whole texts and has the last word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import free_names, numbered, quoted

BUCKETS = 1 << 16
#: What the shares of a text's trigrams are multiplied by, so that weights stay near one.
SCALE = 20.0
#: Trigrams, or words, that a text is taken to have besides its own.
EASE = 60
#: Function words of the languages served.
FUNCTION_WORDS = frozenset(
    "the a an and or of to in is it that this for on with as was are be by at from he she they not "
    "le la les un une de des du et est en que qui dans pour sur par au aux avec il elle ne pas ce "
    "der die das ein eine und oder zu ist in den dem des mit von auf für im nicht es sie er wir "
    "el los las una y o es en que del por con para al se lo su como no más".split()
)
LABELLERS = ("symbols", "capitals", "exclamation", "bars", "function_words", "variety", "stutter", "sentences", "digits")
#: States of a vote: the labeller does not apply, votes bad, sees nothing, votes good.
ABSENT, BAD, NOTHING, GOOD = range(4)

# Classes of bytes: 0 white space, 1 lower case and all non-ASCII, 2 upper case, 3 digits, 4 ordinary marks, 5 '!', 6 '|', 7 other marks.
_CLASS = np.full(256, 7, np.uint8)
_CLASS[128:] = 1
for _n, _chars in enumerate((b" \n\t\r\x0b\x0c", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".,;:?'\"()-", b"!", b"|")):
    _CLASS[list(_chars)] = _n


def votes(text: str | None) -> tuple[int, ...]:
    """The vote of each labeller on a whole text. One that a text is too short for does not apply, on a blank text none does."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(_CLASS[raw], minlength=8)
    chars = int(len(raw) - counts[0])
    if not chars:
        return (ABSENT,) * len(LABELLERS)
    words = text.lower().split()
    n = len(words)
    letters = int(counts[1] + counts[2])
    stops = sum(map(FUNCTION_WORDS.__contains__, words)) / n
    length = n / max(1, text.count(". ") + text.count(".\n") + text.count("? ") + text.count("! ") + text.rstrip().endswith((".", "?", "!")))

    def fault(applies: bool, seen: bool) -> int:
        return ABSENT if not applies else BAD if seen else NOTHING

    return (
        fault(n >= 5, counts[7] / chars > 0.06),
        fault(letters >= 20, counts[2] / max(1, letters) > 0.5),
        fault(n >= 5, counts[5] / n > 0.3),
        fault(n >= 5, counts[6] / n > 0.25),
        ABSENT if n < 20 else GOOD if stops >= 0.1 else BAD if stops <= 0.03 else NOTHING,
        fault(n >= 50, len(set(words)) / n < 0.1),
        fault(n >= 10, sum(map(str.__eq__, words, words[1:])) / n > 0.15),
        ABSENT if n < 20 else GOOD if length <= 30 else BAD if length > 120 else NOTHING,
        fault(chars >= 20, counts[3] / chars > 0.3),
    )


def pattern_of(votes: tuple[int, ...]) -> int:
    """A number for a tuple of votes, its digits base four."""
    number = 0
    for v in votes:
        number = number * 4 + v
    return number


@dataclass(frozen=True)
class LabelModel:
    """``given[q, l, v]``: probability of vote v of labeller l, where it applies, if the quality is q."""

    good: float
    given: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a text with the votes of each pattern is good."""
        digits = patterns[:, None] // 4 ** np.arange(self.given.shape[1])[::-1] % 4
        log = np.log(self.given)[:, np.arange(self.given.shape[1]), digits].sum(axis=2)
        odds = np.log(self.good / (1 - self.good)) + log[1] - log[0]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, labellers: int = len(LABELLERS), good: float = 0.85, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation from pattern counts. It starts where every labeller is right four times of five when it votes, which also fixes which class is the good one."""
    digits = patterns[:, None] // 4 ** np.arange(labellers)[::-1] % 4
    hot = digits[:, :, None] == np.arange(4)
    hot[:, :, ABSENT] = False
    silent = np.clip(((counts[:, None] * hot[:, :, NOTHING]).sum(axis=0) + 1) / ((counts[:, None, None] * hot).sum(axis=(0, 2)) + 2), 0.01, 0.98)[:, None]
    unused, right, wrong = np.ones_like(silent), 0.8 * (1 - silent), 0.2 * (1 - silent)
    model = LabelModel(good, np.stack([np.hstack([unused, right, silent, wrong]), np.hstack([unused, wrong, silent, right])]))
    if not counts.sum():
        return model
    for _ in range(rounds):
        p = model.posterior(patterns)
        weight = np.stack([(1 - p) * counts, p * counts])
        given = np.einsum("qp,plv->qlv", weight, hot) + 0.5
        given[:, :, ABSENT] = 0
        given /= given.sum(axis=2, keepdims=True)
        given[:, :, ABSENT] = 1
        new = LabelModel(float(np.clip(weight[1].sum() / counts.sum(), 0.02, 0.98)), given)
        done = abs(new.good - model.good) < 1e-9 and np.abs(new.given - model.given).max() < 1e-9
        model = new
        if done:
            break
    return model


def hashed_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of a whole text, and two measures of repetition that have weights of their own: repeats of the word before, and of any word. Shares are of the count plus ``EASE``, so short texts stay near the bias."""
    raw = np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    hashed = ((raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16) * np.uint32(2654435761)) >> np.uint32(16)
    words = (text or "").lower().split()
    n = len(words)
    return hashed, SCALE * np.array([sum(map(str.__eq__, words, words[1:])), n - len(set(words))]) / (n + EASE)


def train_scorer(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 300, rate: float = 0.3, decay: float = 1e-5) -> np.ndarray:
    """Weights, then the bias, of a logistic scorer over hashed features, from soft labels; adaptive gradient steps over all rows."""
    width = BUCKETS + 2
    cells = [np.unique(hashed, return_counts=True) for hashed, _ in features]  # a text at a time, so that no array of all trigrams is made
    rows = np.repeat(np.arange(len(features), dtype=np.int32), [len(c[0]) + 2 for c in cells])
    columns = np.concatenate([x for c in cells for x in (c[0].astype(np.int32), np.arange(BUCKETS, width, dtype=np.int32))])
    values = np.concatenate([x for c, f in zip(cells, features) for x in (SCALE * c[1] / (len(f[0]) + EASE), f[1])]).astype(np.float32)
    w, squares = np.zeros(width + 1), np.full(width + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(rows, w[columns] * values, len(features)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels) / len(features)
        slope = np.append(np.bincount(columns, error[rows] * values, width), error.sum())
        slope[:-1] += decay * w[:-1]
        squares += slope * slope
        w -= rate * slope / np.sqrt(squares)
    return w


def score(weights: np.ndarray, features: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability that a text of these features is good."""
    hashed, repeats = features
    z = SCALE * float(weights[hashed].sum()) / (len(hashed) + EASE) + float(weights[BUCKETS:-1] @ repeats) + weights[-1]
    return 1 / (1 + float(np.exp(-np.clip(z, -500, 500))))


_KEYS = pa.schema([("pattern", pa.int64()), ("n", pa.int64())])


def _patterns(docs: DataFrame) -> DataFrame:
    """Counts of vote patterns over all texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for part in parts:
            for text in part.column(0).to_pylist():
                p = pattern_of(votes(text))
                seen[p] = seen.get(p, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], schema=_KEYS)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class QualityModel:
    labels: LabelModel
    weights: np.ndarray


def fit_quality(docs: DataFrame, train_rows: int = 3000, train_bytes: int = 8_000_000) -> QualityModel:
    """Fits the label model on the votes of all texts, and the scorer on a bounded sample.

    The sample is the distinct texts least by a hash: ``train_rows`` of them at
    most, as far as they come to ``train_bytes`` characters together (the first
    in any case). Lengths decide that before any text leaves its executor.
    Long texts take part like short ones. Pattern counts come to the driver: at
    most 4 to the power of the number of labellers rows, whatever the corpus.
    """
    counted = _patterns(docs).collect()
    labels = fit_label_model(np.array([r.pattern for r in counted], np.int64), np.array([r.n for r in counted], np.float64))
    text = F.col("text").cast("string")
    unit = F.pmod(F.xxhash64(text, F.lit(3)), F.lit(1 << 53))
    share = min(1.0, 50 * train_rows / max(1, sum(r.n for r in counted)))  # enough distinct texts at fifty copies each
    drawn = docs.select(text.alias("text"), unit.alias("u")).where((F.col("u") <= int(share * (1 << 53))) & (F.length(F.trim("text")) > 0))
    sizes = drawn.groupBy("u").agg(F.max(F.length("text")).alias("n")).orderBy("u").limit(train_rows).collect()
    within = np.cumsum([r.n for r in sizes]) <= train_bytes
    last = sizes[max(1, int(within.sum())) - 1].u if sizes else -1
    texts = [r.text for r in sorted(drawn.where(F.col("u") <= last).groupBy("u").agg(F.min("text").alias("text")).collect())] if sizes else []
    if not texts:
        return QualityModel(labels, np.append(np.zeros(BUCKETS + 2), 1.0))
    soft = labels.posterior(np.array([pattern_of(votes(t)) for t in texts], np.int64))
    return QualityModel(labels, train_scorer([hashed_features(t) for t in texts], soft))


def added_names(docs: DataFrame) -> list[str]:
    """Names of the posterior, the score and the decision beside the columns of ``docs``."""
    return free_names(docs.columns, "__posterior", "__score", "__kept")


def quality_scores(docs: DataFrame, model: QualityModel, threshold: float = 0.35) -> DataFrame:
    """All columns of ``docs`` with ``__posterior`` (of the labellers), ``__score`` (of the scorer) and ``__kept``; ``added_names`` has these names as they are if ``docs`` holds some of them.

    Blank and null texts have the prior as posterior, score 0 and are not kept.
    Rows are scored one by one, so repeated rows get one score; doc_id is not
    read. A score at the threshold is kept. An empty table gives no rows.
    """
    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    at = docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: the buckets

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for part in parts:
            texts = part.column(at).to_pylist()
            posterior = m.labels.posterior(np.array([pattern_of(votes(t)) for t in texts], np.int64))
            scores = np.array([score(m.weights, hashed_features(t)) if t and t.strip() else 0.0 for t in texts])
            columns = [*part.columns, pa.array(posterior), pa.array(scores), pa.array(scores >= threshold)]
            yield pa.RecordBatch.from_arrays(columns, names=[str(k) for k in range(len(columns))])

    added = [StructField(name, kind()) for name, kind in zip(added_names(docs), (DoubleType, DoubleType, BooleanType))]
    return numbered(docs).mapInArrow(run, StructType([*docs.schema.fields, *added]))


def keep_good(docs: DataFrame, threshold: float = 0.35) -> DataFrame:
    """The documents that the classifier keeps, with the columns of ``docs``, whatever their names. Blank and null texts go."""
    return quality_scores(docs, fit_quality(docs), threshold).where(quoted(added_names(docs)[2])).select(*[quoted(c) for c in docs.columns])
