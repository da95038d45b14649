"""Secret scan: loose candidates, then a random forest that removes false positives.

Candidates are values behind an assignment, passwords of URLs, values of known shape, and long bare
runs of letters and digits, each to its end however long. The forest (Breiman, 2001) sees length, character
transitions, dictionary coverage, path and neighbouring words. It is trained
from labelled findings; unless others are given, a seeded generator writes them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import numbered, quoted
from .token_file import batches
from .words import vocabulary_path

_ASSIGNED = re.compile(r"[=:]>?[ \t]{0,3}([\"'`]?)([^\s\"'`,;<>{}()\[\]=]{8,}={0,2})")
_NAME = re.compile(r"([A-Za-z][\w.-]{0,60})[\"']?[ \t]{0,3}:?$")
_LOGIN = re.compile(r"://[^\s/?#@:\"'`<>]*:([^\s/?#\"'`<>]+)@")  # user:password of a URL
_BARE = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
#: Shapes that providers publish, by their first characters.
SHAPES = {
    "AKIA": r"AKIA[0-9A-Z]{16}", "ASIA": r"ASIA[0-9A-Z]{16}", "ghp_": r"ghp_\w{30,}", "gho_": r"gho_\w{30,}", "github_pat_": r"github_pat_\w{30,}",
    "glpat-": r"glpat-[\w-]{20,}", "xox": r"xox[abprs]-[\w-]{10,}", "sk_live_": r"sk_live_\w{16,}", "sk-": r"sk-[\w-]{20,}", "AIza": r"AIza[\w-]{35}",
    "eyJ": r"eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}",
}
_SHAPES = {k: re.compile(v) for k, v in SHAPES.items()}
_KEY_LINE = re.compile(r"-----(?:(BEGIN)|END) [A-Z ]*PRIVATE KEY-----")
#: Words of neighbourhoods.
SECRET_WORDS = ("secret", "token", "password", "passwd", "pwd", "apikey", "api_key", "access_key", "auth", "credential", "bearer", "private_key", "client_key", "signing", "encryption_key", "connection")
HASH_WORDS = ("sha", "md5", "commit", "checksum", "digest", "uuid", "guid", "etag", "revision", "integrity", "hash", "build", "trace", "span_id", "request_id", "fingerprint", "serial", "isbn")
SAMPLE_WORDS = ("example", "sample", "dummy", "changeme", "placeholder", "your_", "your-", "xxxx", "fake", "redacted", "<", "todo", "insert")
TEST_PATHS = ("test", "example", "sample", "fixture", "mock", "doc", "spec")
FEATURES = (
    "length", "digits", "upper", "lower", "marks", "transitions", "entropy", "distinct", "dictionary", "longest_run", "hexadecimal", "known_shape",
    "secret_name", "hash_name", "sample_value", "secret_near", "hash_near", "sample_near", "test_path", "quoted", "bare", "steps", "key_block", "slashes", "dotted",
)


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    rule: str
    name: str
    quoted: bool


def key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each private key, from a BEGIN line to the END line that follows with no other BEGIN between, however far. One pass."""
    begun = None
    for m in _KEY_LINE.finditer(text) if "-----BEGIN" in text else ():
        if m[1]:
            begun = m
        elif begun and m.start() - begun.end() >= 16:
            yield begun.start(), m.end()
            begun = None


def candidates(text: str) -> list[Candidate]:
    """Values that might be secrets, in order; of overlapping ones the longest, then the more telling rule."""
    found: list[Candidate] = []
    for first, shape in _SHAPES.items():
        if first in text:
            found += [Candidate(m.start(), m.end(), "shape", "", text[m.start() - 1 : m.start()] in "\"'`") for m in shape.finditer(text)]
    found += [Candidate(a, b, "shape", "", text[a - 1 : a] in "\"'`") for a, b in key_blocks(text)]
    for m in _ASSIGNED.finditer(text):
        value = m[2].rstrip(".,!?:")
        if len(value) < 8 or value.startswith("//"):
            continue
        name = _NAME.search(text, max(0, m.start() - 64), m.start())
        named = name[1] if name else ""
        if any(w in named.lower().replace("-", "_") for w in SECRET_WORDS) or (re.search(r"\d", value) and re.search(r"[A-Za-z]", value)):
            found.append(Candidate(m.start(2), m.start(2) + len(value), "assigned", named, bool(m[1])))
    for m in _LOGIN.finditer(text):
        found.append(Candidate(m.start(1), m.end(1), "assigned", "password", False))
    for m in _BARE.finditer(text):
        if re.search(r"\d", m[0]) and re.search(r"[A-Za-z]", m[0]):
            found.append(Candidate(m.start(), m.end(), "bare", "", text[m.start() - 1 : m.start()] in "\"'`"))
    rank = {"shape": 0, "assigned": 1, "bare": 2}
    starts: list[int] = []
    kept: list[Candidate] = []
    for c in sorted(found, key=lambda c: (-(c.end - c.start), rank[c.rule], c.start)):
        at = bisect_left(starts, c.start)  # those kept don't overlap, so only the neighbours can
        if (not at or kept[at - 1].end <= c.start) and (at == len(kept) or kept[at].start >= c.end):
            starts.insert(at, c.start)
            kept.insert(at, c)
    return kept


@lru_cache(maxsize=4)
def dictionary(path: str) -> frozenset[str]:
    """Whole words of four or more letters of a public tokenizer's vocabulary."""
    import json

    with open(path) as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return frozenset(w[:-4] for w in vocabulary if w.endswith("</w>") and len(w) >= 8 and w[:-4].isascii() and w[:-4].isalpha())


def coverage(value: str, words: frozenset[str]) -> float:
    """Share of the letters that dictionary words cover, longest first from the left."""
    letters = covered = 0
    for run in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
        letters += len(run)
        at = 0
        while at < len(run) - 3:
            size = next((n for n in range(min(16, len(run) - at), 3, -1) if run[at : at + n] in words), 0)
            covered += size
            at += size or 1
    return covered / letters if letters else 0.0


def _kind(ch: str) -> int:
    return 0 if ch.isdigit() else 1 if ch.islower() else 2 if ch.isupper() else 3


def features(text: str, c: Candidate, path: str | None, words: frozenset[str]) -> list[float]:
    value = text[c.start : c.end]
    n = len(value)
    kinds = [_kind(ch) for ch in value]
    counts, seen = Counter(value), Counter(kinds)
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    run = best = 1
    for a, b in zip(kinds, kinds[1:]):
        run = run + 1 if a == b else 1
        best = max(best, run)
    steps = sum(ord(b) - ord(a) in (0, 1) for a, b in zip(value, value[1:]))
    near = (text[max(0, c.start - 48) : c.start] + " " + text[c.end : c.end + 24]).lower().replace("-", "_")
    name, low, place = c.name.lower().replace("-", "_"), value[:256].lower(), (path or "").lower()
    has = lambda words, where: float(any(w in where for w in words))
    return [
        math.log2(n), *(seen[k] / n for k in (0, 2, 1, 3)), changes / n, -sum(k / n * math.log2(k / n) for k in counts.values()), len(counts) / min(n, 64),
        coverage(value, words), best / n, float(re.fullmatch(r"[0-9a-fA-F-]+", value) is not None), float(c.rule == "shape"),
        has(SECRET_WORDS, name), has(HASH_WORDS, name), has(SAMPLE_WORDS, low), has(SECRET_WORDS, near), has(HASH_WORDS, near), has(SAMPLE_WORDS, near),
        has(TEST_PATHS, place), float(c.quoted), float(c.rule == "bare"), steps / n, float(value.startswith("-----BEGIN")), value.count("/") / n, float(value.count(".") >= 2),
    ]


def labelled_findings(n: int = 4000, seed: int = 23, path: str | None = None) -> list[tuple[str, str, Candidate, bool]]:
    """(text, path, candidate, is a secret) from a seeded generator: random values under telling names, key blocks and passwords of URLs, and hashes, ids, samples, words, numbers, paths, encoded pictures, certificates' digests and signed packages that look alike."""
    r = np.random.default_rng(seed)
    vocabulary = sorted(dictionary(path or vocabulary_path()))
    word = lambda: vocabulary[r.integers(len(vocabulary))]
    pick = lambda options: options[r.integers(len(options))]
    draw = lambda chars, size: "".join(np.array(list(chars))[r.integers(0, len(chars), size)])
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    any_case = low + low.upper() + digits

    def value(secret: bool) -> tuple[str, str]:
        if secret:
            kind = r.integers(9)
            name = pick(["token", "secret", "api_key", "API_KEY", "auth_token", "client_secret", "access_key", "TOKEN", "password", "credential", "bearer", "client-key-data", "private-key", "signing_key", "encryption_key"])
            neutral = pick(["note", "value", "see", "key", "config", "url", "data"])
            if kind == 6:  # a block of lines, under any name or none
                lines = "\n".join(draw(any_case + "+/", 64) for _ in range(int(r.integers(3, 30))))
                label = pick(["", "RSA ", "EC ", "OPENSSH "])
                return pick([name, neutral]), f"-----BEGIN {label}PRIVATE KEY-----\n{lines}\n-----END {label}PRIVATE KEY-----"
            if kind == 7:  # long ones
                return name, draw(any_case + "+/", int(r.integers(90, 2400)))
            if kind == 8:  # signed in three parts
                return pick([name, neutral]), ".".join(("eyJ" + draw(any_case, int(r.integers(17, 60))), "eyJ" + draw(any_case, int(r.integers(30, 200))), draw(any_case + "-_", 43)))
            made = [lambda: draw(digits + "abcdef", pick([32, 40, 64])), lambda: draw(any_case, int(r.integers(20, 64))), lambda: draw(any_case + "+/", pick([40, 43, 64, 86])),
                    lambda: draw(any_case + "!@#$%^&*-_", int(r.integers(10, 20))), lambda: pick(["AKIA", "ASIA"]) + draw(low.upper() + digits, 16), lambda: pick(["ghp_", "sk_live_", "glpat-"]) + draw(any_case, 36)][kind]()
            return (name, made.upper() if kind == 0 and r.random() < 0.2 else made)
        kind = r.integers(16)
        neutral = pick(["name", "path", "url", "id", "version", "title", "key", "value", "ref"])
        return [
            lambda: (pick(["commit", "sha1", "md5", "checksum", "digest", "etag", "revision", "sha256"]), draw(digits + "abcdef", pick([32, 40, 64]))),
            lambda: (pick(["uuid", "request_id", "guid", "trace", neutral]), "-".join(draw(digits + "abcdef", k) for k in (8, 4, 4, 4, 12))),
            lambda: (pick(["token", "password", "api_key", "secret"]), pick(["changeme", "your_api_key_here", "example-token-1234", "xxxxxxxxxxxxxxxx", "REDACTED_VALUE", "placeholder_123", "dummy-secret-000"])),
            lambda: (pick([neutral, "token", "secret", "auth"]), pick("_-.").join(word() for _ in range(int(r.integers(2, 5))))),
            lambda: (neutral, "/" + "/".join(word() for _ in range(int(r.integers(2, 5)))) + f"/v{r.integers(9)}"),
            lambda: (neutral, draw(digits, int(r.integers(8, 20)))),
            lambda: (neutral, word() + word().title() + word().title() + str(r.integers(100))),
            lambda: (pick(["pattern", "alphabet", "charset"]), (digits + low + low.upper())[: int(r.integers(24, 62))]),
            lambda: (pick(["build", "hash", "integrity", "span_id"]), draw(any_case, int(r.integers(24, 44)))),
            lambda: (pick(["integrity", "resolved", "sha512"]), "sha512-" + draw(any_case + "+/", 86) + "=="),
            lambda: (pick(["src", "href", "background", "image"]), "data:image/png;base64" + "," + draw(any_case + "+/", int(r.integers(40, 600)))),
            lambda: (pick(["fingerprint", "serial", "thumbprint", "SHA256"]), ":".join(draw(digits + "ABCDEF", 2) for _ in range(int(r.integers(16, 33))))),
            lambda: (neutral, f"https://{word()}.example/{word()}/{draw(digits, 6)}?{word()}={draw(any_case, int(r.integers(8, 24)))}&{word()}={r.integers(1000)}"),
            lambda: (pick(["date", "time", "created", neutral]), f"20{r.integers(10, 30)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}T{r.integers(24):02d}:{r.integers(60):02d}:{r.integers(60):02d}Z"),
            lambda: (pick(["token", "password", "secret", "auth"]), pick(["process.env.", "os.environ/", "config.", "${", "$(", "vault:"]) + "_".join(word().upper() for _ in range(3)) + str(r.integers(10))),
            lambda: (pick(["class", "id", "testid", "selector"]), "-".join([word(), word(), draw(low + digits, 5), str(r.integers(100)), word()])),
        ][kind]()

    out = []
    while len(out) < n:
        secret = bool(r.random() < 0.5)
        name, made = value(secret)
        prose = lambda: " ".join(word() for _ in range(int(r.integers(0, 8))))
        quote = pick(['"', "'", "", ""])
        form = r.random()
        joint = pick([" = ", "=", ": ", " := "]) if form < 0.75 else " "  # else only the neighbouring word tells
        text = f"{prose()} {name}{joint}{quote}{made}{quote}{pick([' ', '. ', '\n', ', '])}{prose()}"
        if r.random() < 0.06:  # a login in a URL, the password weak or strong, or a sample's
            made = pick([word() + str(r.integers(10, 99)) + pick(["", "!", word()]), draw(any_case + "!$*", int(r.integers(8, 20)))]) if secret else pick(["password", "changeme", "example123", "PASSWORD", "your_password", "xxxxxxxx", "<password>"])
            text = f"{prose()} {pick(['postgres', 'mysql', 'redis', 'amqp', 'https', 'mongodb'])}://{word()}:{made}@{word()}.{pick(['host', 'internal', 'example'])}/{word()} {prose()}"
        where = pick(["src", "web", "app", "tests/fixtures", "docs/example", "", "src7"])
        hit = [c for c in candidates(text) if made[:8] in text[c.start : c.end]]
        if hit:
            out.append((text, where, hit[0], secret))
    return out


class Forest:
    """Trees over features cut into 32 bins; grown to a depth on bootstrap samples, each node choosing among a few random features by Gini impurity."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 10, least: int = 4, seed: int = 29):
        r = np.random.default_rng(seed)
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in rows.T]
        binned = self._binned(rows)
        tried = max(1, round(math.sqrt(rows.shape[1])))
        self.trees = []
        for _ in range(trees):
            drawn = r.integers(0, len(rows), len(rows))
            nodes: list[list[float]] = []  # feature, bin, left, right, share of secrets

            def grow(own: np.ndarray, level: int) -> int:
                at, share = len(nodes), float(labels[own].mean())
                nodes.append([-1, 0, 0, 0, share])
                if level == depth or len(own) < 2 * least or share in (0, 1):
                    return at
                best = (0.0, -1, 0)
                for f in r.choice(rows.shape[1], tried, replace=False):
                    total = np.bincount(binned[own, f], minlength=33)
                    true = np.bincount(binned[own, f], labels[own], 33)
                    n, p = np.cumsum(total)[:-1], np.cumsum(true)[:-1]
                    m, q = len(own) - n, labels[own].sum() - p
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where((n >= least) & (m >= least), p * p / n + (n - p) ** 2 / n + q * q / m + (m - q) ** 2 / m, 0.0)
                    cut = int(gain.argmax())
                    if gain[cut] > best[0]:
                        best = (float(gain[cut]), int(f), cut)
                s = labels[own].sum()
                if best[1] < 0 or best[0] <= (s * s + (len(own) - s) ** 2) / len(own) + 1e-9:
                    return at
                goes = binned[own, best[1]] <= best[2]
                left = grow(own[goes], level + 1)
                right = grow(own[~goes], level + 1)
                nodes[at] = [best[1], best[2], left, right, share]
                return at

            grow(drawn, 0)
            self.trees.append(np.array(nodes))

    def _binned(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, rows.T)], axis=1)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """Mean over the trees of the share of secrets in the leaf."""
        if not len(rows):
            return np.zeros(0)
        binned, total = self._binned(rows), np.zeros(len(rows))
        for nodes in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (inner := nodes[at, 0] >= 0).any():
                k = np.flatnonzero(inner)
                f, cut = nodes[at[k], 0].astype(int), nodes[at[k], 1]
                at[k] = np.where(binned[k, f] <= cut, nodes[at[k], 2], nodes[at[k], 3]).astype(np.int64)
            total += nodes[at, 4]
        return total / len(self.trees)


def fit_forest(findings: list[tuple[str, str, Candidate, bool]] | None = None, tokenizer: str | None = None) -> Forest:
    """Trains on labelled findings (default: the generator's); their number is the bound of this step."""
    path = tokenizer or vocabulary_path()
    words = dictionary(path)
    findings = findings if findings is not None else labelled_findings(path=path)
    return Forest(np.array([features(t, c, p, words) for t, p, c, _ in findings]), np.array([float(y) for *_, y in findings]))


def scan(text: str | None, path: str | None, forest: Forest, words: frozenset[str]) -> list[tuple[Candidate, float]]:
    found = candidates(text) if text else []
    if not found:
        return []
    return list(zip(found, forest.predict(np.array([features(text, c, path, words) for c in found])).tolist()))


def scan_secrets(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, path: str = "source", tokenizer: str | None = None) -> DataFrame:
    """Every candidate of every whole text: doc_id, start, end (characters), rule, name, shown (the first four characters), score, is_secret.

    ``docs`` needs doc_id, text and the column ``path``. Null or empty texts and
    texts without candidates give no rows; a null path is an empty one; rows
    that repeat give their findings each. An empty table gives no rows.
    """
    place = tokenizer or vocabulary_path()
    held = docs.sparkSession.sparkContext.broadcast(forest or fit_forest(tokenizer=place))  # a bounded number of nodes
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("rule", pa.string()), ("name", pa.string()), ("shown", pa.string()), ("score", pa.float64()), ("is_secret", pa.bool_())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = dictionary(place)

        def rows():
            for part in parts:
                for doc_id, text, where in zip(*(c.to_pylist() for c in part.columns)):
                    for c, p in scan(text, where, held.value, words):
                        yield doc_id, c.start, c.end, c.rule, c.name, text[c.start : c.start + 4], p, p >= threshold

        yield from batches(rows(), schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), quoted(path).cast("string")).mapInArrow(run, "doc_id long, start int, end int, rule string, name string, shown string, score double, is_secret boolean")


def redact_secrets(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, path: str = "source", mark: str = "[SECRET]", tokenizer: str | None = None) -> DataFrame:
    """``docs`` with each secret replaced by ``mark``; n_chars, if there, follows the new text. All rows and columns, whatever their names, stay; texts without secrets stay as they are, null as null; an empty table stays empty."""
    place = tokenizer or vocabulary_path()
    held = docs.sparkSession.sparkContext.broadcast(forest or fit_forest(tokenizer=place))
    at, where, count = docs.columns.index("text"), docs.columns.index(path), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def clean(text: str | None, source: str | None, words: frozenset[str]) -> str | None:
        for c, p in reversed(scan(text, source, held.value, words)):
            if p >= threshold:
                text = text[: c.start] + mark + text[c.end :]
        return text

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = dictionary(place)
        for part in parts:
            old = part.column(at).to_pylist()
            new = [clean(t, None if s is None else str(s), words) for t, s in zip(old, part.column(where).to_pylist())]
            columns = list(part.columns)
            if new != old:
                columns[at] = pa.array(new, columns[at].type)
                if count >= 0:
                    sizes = [n if a == b else len(b) for a, b, n in zip(old, new, columns[count].to_pylist())]
                    columns[count] = pa.array(sizes, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return numbered(docs).mapInArrow(run, docs.schema)
