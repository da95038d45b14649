"""Token ids of whole texts by a public tokenizer, one distinct word at a time."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

#: Characters of text that are looked up at once.
PIECE_CHARS = 1 << 20
#: A mark behind a letter and before white space is a token of its own.
_STOP = re.compile(r"([.,;:!?])(?<=[a-zß-öø-ÿ].)(?=[ \n]|\Z)")
#: Letters, or letters and then marks: exactly one or two pre-tokens.
_PLAIN = re.compile(r"[^\W\d_²³¹¼½¾]+([^\w\s'<|>]+)?")


def split_words(text: str) -> list[str]:
    """Parts whose ids, one after the other, are the ids of the text.

    Texts within Latin-1 are put in lower case, as the vocabulary's normalizer
    does to each character, and single marks are cut off, so that there are
    fewer different parts; other texts are only cut at blanks and line ends.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.replace("\n", " ").split(" ")
    if "<|" not in text:
        text = _STOP.sub(r" \1", text.lower())
    return text.replace("\n", " ").split(" ")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _runs(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (sizes[0] of them), then those from first[1], and so on."""
    starts = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(first - starts, sizes)


class _Rows(dict):
    """Numbers words in the order in which they are first asked for."""

    def __init__(self):
        super().__init__({"": 0})
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.new.append(word)
        return row


class WordEncoder:
    """Exactly the ids of ``Tokenizer.encode(text, add_special_tokens=False)``.

    The vocabulary's pre-tokenizer drops white space and never joins characters
    across it, so the ids of a text are those of its parts between blanks and
    line ends, one after the other. A word is encoded the first time a worker
    meets it and looked up afterwards. At ``cap`` words those that were not met
    again are forgotten, so memory stays bounded whatever the corpus.
    """

    def __init__(self, path: str, cap: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cap = cap
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.index = _Rows()
        self.known = 1  # rows that have their ids
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.first = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.met = np.zeros(1 << 14, np.int32)

    def _forget(self) -> None:
        """Keeps the words met in two pieces of text or more since the last time."""
        old, first, length, flat, met = self.index, self.first, self.length, self.flat, self.met
        self._clear()
        kept = [w for w, row in old.items() if row and met[row] > 1][: self.cap // 2]
        rows = np.array([old[w] for w in kept], np.int64)
        self.index.update(zip(kept, range(1, len(kept) + 1)))
        self._add(flat[_runs(first[rows], length[rows])], length[rows])

    def _learn(self, words: list[str]) -> None:
        """Adds the ids of the words that got rows, in their order. Words of letters, with at most one run of marks behind, are encoded in long rows of text, which costs a third of one call each."""
        for at in range(0, len(words), 4000):
            part = words[at : at + 4000]
            ends = [1 if w.isalpha() else 0 for w in part]
            for i, n in enumerate(ends):
                if not n and (m := _PLAIN.fullmatch(part[i])):
                    ends[i] = 2 if m[1] else 1
            plain = [w for w, n in zip(part, ends) if n]
            odd = [w for w, n in zip(part, ends) if not n]
            row, *single = self.tokenizer.encode_batch_fast([" ".join(plain), *odd], add_special_tokens=False)
            ids = np.array(row.ids, np.uint32)
            found = np.flatnonzero(self.is_end[ids]) + 1
            wanted = np.cumsum([n for n in ends if n], dtype=np.int64)
            if len(plain) and len(found) != wanted[-1]:  # letters and marks have an end each: no word can have fewer, but some had more
                for w in part:
                    own = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32)
                    self._add(own, np.array([len(own)]))
                continue
            sizes = np.zeros(len(part), np.int64)
            is_plain = np.array(ends) > 0
            if len(plain):
                sizes[is_plain] = np.diff(found[wanted - 1], prepend=0)
            sizes[~is_plain] = [len(e.ids) for e in single]
            if odd:  # back into the order of the words
                merged = np.zeros(int(sizes.sum()), np.uint32)
                belongs = np.repeat(is_plain, sizes)
                merged[belongs] = ids
                merged[~belongs] = np.concatenate([np.array(e.ids, np.uint32) for e in single])
                ids = merged
            self._add(ids, sizes)

    def _add(self, new: np.ndarray, sizes: np.ndarray) -> None:
        rows = self.known + len(sizes)
        if self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(new)), np.uint32)])
        while rows > len(self.first):
            self.first, self.length, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.length, self.met))
        self.flat[self.used : self.used + len(new)] = new
        self.first[self.known : rows] = self.used + np.cumsum(sizes) - sizes
        self.length[self.known : rows] = sizes
        self.used += len(new)
        self.known = rows

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has."""
        if len(self.index) > self.cap:
            self._forget()
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            self._learn(self.index.new)
            self.index.new.clear()
        self.met[at] += 1
        sizes = self.length[at]
        return self.flat[_runs(self.first[at], sizes)], sizes

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text in turn; a null text has none. Long texts are looked up piece by piece."""
        words: list[str] = []
        counts: list[int] = []
        chars = 0

        def flush() -> Iterator[np.ndarray]:
            if counts:
                ids, sizes = self._ids(words) if words else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
                ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
                yield from np.split(ids, ends[:-1])
                words.clear()
                counts.clear()

        for text in texts:
            text = text or ""
            if len(text) > PIECE_CHARS:
                yield from flush()
                chars = 0
                yield self._long(text)
                continue
            part = split_words(text)
            words += part
            counts.append(len(part))
            chars += len(text)
            if chars >= PIECE_CHARS:
                yield from flush()
                chars = 0
        yield from flush()

    def _long(self, text: str) -> np.ndarray:
        found, at = [], 0
        while at < len(text):
            end = min(at + PIECE_CHARS, len(text))
            if end < len(text):
                cuts = [c for c in (text.rfind(" ", at, end), text.rfind("\n", at, end)) if c >= 0]
                if cuts:
                    end = max(cuts) + 1
                else:  # a single word longer than a piece
                    after = [c for c in (text.find(" ", end), text.find("\n", end)) if c >= 0]
                    end = min(after) + 1 if after else len(text)
            found.append(self._ids(split_words(text[at:end]))[0])
            at = end
        return np.concatenate(found)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for a worker process, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
