"""Encoding of whole texts with a file of the ``tokenizers`` library, fast enough for bulk work.

A text's ids are those of its space-separated pieces, one after another: both kinds of vocabulary used here never let a
token reach across a single space between two visible characters. So each distinct piece is encoded once by the
library and remembered, and a batch of texts becomes array lookups. Texts with other white space next to a space, and
texts that hold the string of one of the vocabulary's added tokens, are encoded whole by the library as it comes.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as the vocabularies' patterns see it, and the separators that Python adds to it.
_SPACE = r"\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_RISKY = rf"^[{_SPACE}]| $| [{_SPACE}]|[{_SPACE}] "
#: Pieces that an encoder remembers before it drops those it met once (some 150 bytes each, in all), and ids for each.
MOST_PIECES, IDS_OF_PIECE = 300_000, 8
#: Text bytes that are encoded at a time: the more, the more pieces are looked up once.
ENCODE_BYTES = 4 << 20
#: Encodes as one string: this many new pieces.
_TOGETHER = 20_000


class BatchEncoder:
    """ids of Arrow arrays of texts under one vocabulary file, as the library gives them."""

    def __init__(self, path: str, most: int = MOST_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.most = most
        # how the added tokens begin, as far as that has no letters; what holds it goes to the library, which decides
        self.added = {re.match(r"[^\W\d_]+|[\W\d_]+", x.content)[0] for x in self.library.get_added_tokens_decoder().values()}
        vocabulary = self.library.get_vocab()
        self.spaced = bool(self.library.encode(" ", add_special_tokens=False).ids)  # a leading space belongs to the token
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, k in vocabulary.items():
            self.opens[k] = token.startswith("Ġ")
        self.mark = None if self.spaced else self.library.encode("\x01", add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[str | int, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.again = np.zeros(1 << 14, bool)  # pieces that were met in more than one batch

    def _tidy(self) -> None:
        """Forgets the pieces that were met once; all of them if the others are more than half."""
        kept = np.flatnonzero(self.again[: len(self.slots)])
        sizes = self.sizes[kept].astype(np.int64)
        total = int(sizes.sum())
        if 2 * len(kept) > self.most or 2 * total > IDS_OF_PIECE * self.most:
            return self._forget()
        pieces = list(self.slots)  # in the order of their slots
        ids = self.pool[np.repeat(self.starts[kept] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)]
        self._forget()
        self._add([pieces[k] for k in kept.tolist()], ids, sizes)

    def _add(self, pieces: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remembers pieces whose ids stand one after another."""
        n, at = len(self.slots), self.used
        while len(self.starts) < n + len(pieces):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
            self.again = np.resize(self.again, 2 * len(self.again))
        while len(self.pool) < at + len(ids):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[at : at + len(ids)] = ids
        self.starts[n : n + len(pieces)] = at + np.cumsum(sizes) - sizes
        self.sizes[n : n + len(pieces)] = sizes
        self.again[n : n + len(pieces)] = False
        self.used += len(ids)
        self.slots.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def _singly(self, pieces: list[str]) -> None:
        ids = self._library_ids(pieces)
        self._add(pieces, np.array([k for x in ids for k in x], np.uint32), np.array([len(x) for x in ids], np.int64))

    def _library_ids(self, texts: list[str], added: bool = False) -> list[list[int]]:
        """What the library gives; strings of added tokens are those tokens only if told so."""
        self.library.encode_special_tokens = not added
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, pieces: list[str]) -> None:
        """Encodes pieces as one string and cuts its ids at the spaces or marks."""
        if self.spaced:
            ids = np.array(self._library_ids(["".join(pieces)])[0], np.uint32)
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) != len(pieces) or cuts[0]:
                return self._singly(pieces)
            return self._add(pieces, ids, np.diff(np.append(cuts, len(ids))))
        if len(self.mark) != 1 or any("\x01" in x for x in pieces):
            return self._singly(pieces)
        ids = np.array(self._library_ids([" \x01 ".join(pieces) + " \x01"])[0], np.uint32)
        marks = ids == self.mark[0]
        ends = np.flatnonzero(marks)
        if len(ends) != len(pieces):
            return self._singly(pieces)
        return self._add(pieces, ids[~marks], np.diff(np.concatenate([[-1], ends])) - 1)

    def _find(self, pieces: list[str], singly: bool = False) -> np.ndarray:
        """The slots of pieces; new ones are encoded first."""
        get = self.slots.get
        found = np.array([get(x, -1) for x in pieces], np.int64)
        self.again[found[found >= 0]] = True
        lacking = np.flatnonzero(found < 0).tolist()
        if lacking:
            new = list(dict.fromkeys([pieces[k] for k in lacking]))
            if singly:
                self._singly(new)
            else:
                self._pile(new)
            found[lacking] = [get(pieces[k]) for k in lacking]
        return found

    def _pile(self, pieces: list[str]) -> None:
        for k in range(0, len(pieces), _TOGETHER):
            self._together(pieces[k : k + _TOGETHER])

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(slots, pieces by text) of texts that a single space may cut."""
        lists = pc.split_pattern(texts if self.spaced else pc.ascii_lower(texts), " ")  # the other kind lower-cases all
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = flat.dictionary_encode()
        codes, pieces = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        if not self.spaced:
            return self._find(pieces)[codes], offsets
        first = offsets[:-1]
        opening = flat.take(pa.array(first)).to_pylist()
        later = np.ones(len(codes), bool)
        later[first] = False
        seen = np.zeros(len(pieces), bool)
        seen[codes[later]] = True
        kept = np.flatnonzero(seen)
        spaced = [" " + pieces[k] for k in kept.tolist()]
        table = np.zeros(len(pieces), np.int64)
        table[kept] = self._find(spaced)
        slots = table[codes]
        slots[first] = self._find(opening, True)
        return slots, offsets

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by end; offsets by text). texts: no nulls, not empty."""
        if len(self.slots) > self.most or self.used > IDS_OF_PIECE * self.most:
            self._tidy()
        n = len(texts)
        whole = pc.match_substring_regex(texts, _RISKY).to_numpy(zero_copy_only=False) if self.spaced else np.zeros(n, bool)
        for start in self.added:
            whole = whole | pc.match_substring(texts, start, ignore_case=start[:1].isalpha()).to_numpy(zero_copy_only=False)
        per, parts = np.ones(n, np.int64), []
        if not whole.all():
            slots, offsets = self._split(texts.filter(pa.array(~whole)))
            per[~whole] = np.diff(offsets)
            parts.append((~whole, slots))
        if whole.any():
            # whole texts are not remembered: their ids lie behind the others' and their slots go again
            kept, used = len(self.slots), self.used
            ids = self._library_ids(texts.filter(pa.array(whole)).to_pylist(), True)
            self._add(list(range(len(ids))), np.array([k for x in ids for k in x], np.uint32), np.array([len(x) for x in ids], np.int64))
            for k in range(len(ids)):
                del self.slots[k]
            self.used = used
            parts.append((whole, kept + np.arange(len(ids))))
        bounds = np.concatenate([[0], np.cumsum(per)])
        slots = np.empty(bounds[-1], np.int64)
        for mask, own in parts:
            slots[np.repeat(mask, per)] = own
        sizes = self.sizes[slots].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.starts[slots] - (ends - sizes), sizes) + np.arange(total)]
        offsets = np.concatenate([[0], ends])[bounds] + np.arange(n + 1)
        out = np.empty(total + n, np.uint32)
        stops = np.zeros(total + n, bool)
        stops[offsets[1:] - 1] = True
        out[stops], out[~stops] = end, ids
        return out, offsets


_ENCODERS: dict[str, BatchEncoder] = {}


def encoder(path: str, most: int = MOST_PIECES) -> BatchEncoder:
    """The encoder of this Python worker, kept between its tasks; most: pieces that it remembers."""
    if path not in _ENCODERS or _ENCODERS[path].most != most:
        _ENCODERS.clear()
        _ENCODERS[path] = BatchEncoder(path, most)
    return _ENCODERS[path]


def default_vocabulary(name: str) -> str:
    """Where the installed public vocabulary files are."""
    import public_tokenizers

    return public_tokenizers.path(name)
