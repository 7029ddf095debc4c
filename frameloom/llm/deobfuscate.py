"""A noisy channel for disguised words: character lattices decoded under a character language model.

The channel turns letters into look-alike digits and signs, repeats them, and puts marks or spaces between them. Each
disguised word becomes a lattice of the letters that it may stand for, and a Viterbi search with the last two characters
as state, none of them dropped, finds the likeliest path under trigram counts of all words of the corpus. Spaces between
short pieces are part of the lattice too, so that the counts cut a spelled-out run into words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, words_of

#: Symbols of the language model: 0 is a word's edge, a to z have their own, other letters share the rest.
SYMBOLS = 64
#: What letters a sign may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "£": "l", "(": "c", "*": "abcdefghijklmnopqrstuvwxyz",
}
#: Marks that may stand between letters.
MARKS = ".-_·*~'​"
#: Longer words are decoded too, but not remembered; a run of more than STARS equal * is an ornament and stands for nothing.
REMEMBERED, STARS = 128, 12
#: Log probabilities of the channel: a sign for a letter, a sign for itself, a mark put in, letters repeated once or more.
_SIGN, _ITSELF, _MARK, _TWICE = -1.0, -9.0, -0.5, -1.5

_LETTERS = r"\p{L}"
_SIGNS = "".join("\\" + x if x.isascii() and not x.isalnum() else x for x in LOOKS_LIKE)
#: A disguised word: letters with signs or marks between, a sign before or after a letter, or a letter three times.
DISGUISED = rf"{_LETTERS}[{_SIGNS}\.\-_·~']+{_LETTERS}|[{_SIGNS}]{_LETTERS}|{_LETTERS}[{_SIGNS}]|" + "|".join(f"{x}{{3}}" for x in "abcdefghijklmnopqrstuvwxyz")


def symbols(points: np.ndarray) -> np.ndarray:
    """The symbol of each code point of small letters."""
    return np.where((points >= 97) & (points <= 122), points - 96, 27 + points % (SYMBOLS - 27)).astype(np.int64)


def character_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(code, n): how often each three symbols follow one another in the words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SYMBOLS**3, np.int64)
        for batch in slices(batches, "text"):
            codes, _, words = words_of(batch.column("text"), "utf8")
            if not words:
                continue
            often = np.bincount(codes, minlength=len(words))
            listed = pc.utf8_trim(pa.array(words, pa.large_string()), ".,;:!?()\"'|#$%&*")
            plain = pc.utf8_is_alpha(listed).to_numpy(zero_copy_only=False)
            listed, often = listed.filter(pa.array(plain)), often[plain]
            if not len(listed):
                continue
            # two edges before each word, one after
            sizes = pc.utf8_length(listed).to_numpy().astype(np.int64) + 3
            points = np.frombuffer(("\0\0" + "\0\0\0".join(listed.to_pylist()) + "\0").encode("utf-32-le"), np.uint32).astype(np.int64)
            own = np.where(points == 0, 0, symbols(points))
            code = (own[:-2] * SYMBOLS + own[1:-1]) * SYMBOLS + own[2:]
            weight = np.repeat(often, sizes)[: len(code)]
            counts += np.bincount(code, weights=weight, minlength=SYMBOLS**3).astype(np.int64)
        seen = np.flatnonzero(counts)
        if len(seen):
            yield pa.RecordBatch.from_pydict({"code": seen.astype(np.int32), "n": counts[seen]})

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "code int, n long")
    return found.groupBy("code").agg(F.sum("n").alias("n"))


class Channel:
    """Restores disguised words under a language model given as trigram counts."""

    def __init__(self, counts: np.ndarray):
        cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64) + 0.02
        self.model = np.log(cube / cube.sum(axis=2, keepdims=True)).astype(np.float32)
        self.known: dict[str, str] = {}
        self.flat: list[float] | None = None
        self.led: dict = {}
        self.ends: dict = {}

    @classmethod
    def of(cls, counted: DataFrame) -> Channel:
        """From character_counts(): at most SYMBOLS cubed rows."""
        counts = np.zeros(SYMBOLS**3, np.int64)
        for x in counted.collect():
            counts[x.code] = x.n
        return cls(counts)

    def restore(self, word: str) -> str:
        """The likeliest word of letters behind a disguised one in small letters."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self._decode(word)
            if len(word) <= REMEMBERED:
                self.known[word] = found
        return found

    def _decode(self, word: str) -> str:
        model = self._listed()
        states: dict[tuple[int, int], float] = {(0, 0): 0.0}
        back: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []  # for each place, where a state came from
        places = lattice(word)
        lead, tail = len(word) - len(word.lstrip("*")), len(word) - len(word.rstrip("*"))
        lead, tail = lead * (lead <= STARS), tail * (tail <= STARS)
        if lead in self.led:  # the same after as many * for all words
            states, back = self.led[lead][0], list(self.led[lead][1])
        for options in places[len(back) : len(places) - tail]:
            moves = [(x, ord(x) - 96 if "a" <= x <= "z" else int(symbols(np.array([ord(x)]))[0]) if x else 0, cost) for x, cost in options]
            ahead: dict[tuple[int, int], float] = {}
            came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
            for state, score in states.items():
                at = (state[0] * SYMBOLS + state[1]) * SYMBOLS
                for letter, c, cost in moves:
                    if letter == " ":  # a word's end; of a word without letters nothing is left
                        to, new = (0, 0), score + cost + (model[at] if state != (0, 0) else 0.0)
                    elif letter:
                        to, new = (state[1], c), score + cost + model[at + c]
                    else:
                        to, new = state, score + cost
                    if to not in ahead or new > ahead[to]:
                        ahead[to], came[to] = new, (state, letter)
            states = ahead
            back.append(came)
            if len(back) == lead:
                self.led[lead] = states, list(back)
        state = max(states, key=lambda x: states[x] + self._finish(x, tail)[0])
        path = [self._finish(state, tail)[1]]
        for came in reversed(back):
            state, letter = came[state]
            path.append(letter)
        return "".join(reversed(path))

    def _finish(self, state: tuple[int, int], stars: int) -> tuple[float, str]:
        """Log probability and letters of the likeliest end of a word from a state on, with so many * left."""
        if (found := self.ends.get((state, stars))) is None:
            at = (state[0] * SYMBOLS + state[1]) * SYMBOLS
            if not stars:
                found = (self.flat[at] if state != (0, 0) else 0.0, "")
            else:
                options = lattice("*")[0]
                after = [(x, cost, ord(x) - 96 if x.isalpha() else int(symbols(np.array([ord(x)]))[0])) for x, cost in options if x]
                rest = [(cost + self.flat[at + c] + (end := self._finish((state[1], c), stars - 1))[0], x + end[1]) for x, cost, c in after]
                rest += [(cost + (end := self._finish(state, stars - 1))[0], end[1]) for x, cost in options if not x]
                found = max(rest)
            self.ends[(state, stars)] = found
        return found

    def _listed(self) -> list[float]:
        """The model as one list, which is read faster; made in each process anew."""
        if self.flat is None:
            self.flat = self.model.ravel().tolist()
        return self.flat

    def __getstate__(self) -> dict:
        return {"model": self.model, "known": {}, "flat": None, "led": {}, "ends": {}}


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each place of a word the letters that it may stand for, with log probabilities; an empty one is left out.

    Three or more equal characters stand for one or two letters, but each * for one of its own, up to STARS of them. A space in the word ends
    a word or is left out, and signs at the edges of pieces between spaces may be left out.
    """
    out: list[list[tuple[str, float]]] = []
    spaced = " " in word
    k = 0
    while k < len(word):
        c, to, n = word[k], k + 1, 1
        if c == " ":
            out.append([(" ", 0.0), ("", _MARK)])
            k += 1
            continue
        while (at := to + (word[to : to + 1] == " ")) < len(word) and word[at] == c:
            to, n = at + 1, n + 1
        if c in LOOKS_LIKE:
            letters = LOOKS_LIKE[c]
            options = [(x, _SIGN - math.log(len(letters))) for x in letters] + [(c, _ITSELF)]
        elif c in MARKS:
            options = []
        else:
            options = [(c, 0.0)]
        if c in MARKS or (spaced and not c.isalnum() and (word[k - 1 : k] in ("", " ")) != (word[k + 1 : k + 2] in ("", " "))):
            options.append(("", _MARK))
        if c == "*" and n > STARS:
            k = to
        elif n < 3 or c == "*":
            out.append(options)
            k += 1
        else:
            out += [options, [(x, p + _TWICE) for x, p in options] + [("", 0.0)]]
            k = to
    return out


def spaced_runs(sizes: np.ndarray, offsets: np.ndarray, codes: np.ndarray, words: list[str]) -> list[tuple[int, str]]:
    """(text, run) of what may be words with spaces put in, of any length: three or more pieces in a row, of up to three
    characters with two or more single ones, or of up to two characters with a single one. sizes: of the distinct words."""
    if not len(codes):
        return []
    first = np.zeros(len(codes) + 1, bool)
    first[offsets] = True  # a run ends with its text
    single = np.concatenate([[0], np.cumsum((sizes == 1)[codes])])
    free = np.ones(len(codes), bool)
    out = []
    for longest, singles in ((3, 2), (2, 1)):
        own = (sizes <= longest)[codes] & free
        starts = np.flatnonzero(own & (first[:-1] | ~np.concatenate([[False], own[:-1]])))
        stops = np.flatnonzero(own & (first[1:] | ~np.concatenate([own[1:], [False]]))) + 1
        good = (stops - starts >= 3) & (single[stops] - single[starts] >= singles)
        for a, b in zip(starts[good].tolist(), stops[good].tolist(), strict=True):
            run = " ".join(words[k] for k in codes[a:b].tolist())
            free[a:b] = False
            if any(map(str.isalnum, run)):
                out.append((int(np.searchsorted(offsets, a, "right")) - 1, run))
    return out
