"""Pieces of texts under a vocabulary file of ``tokenizers`` (.json) or ``sentencepiece`` (.model), encoded once each.

A text is cut where no token of the vocabulary reaches across: at white space if the vocabulary drops it, else before
each single space between two visible characters; the space belongs to the piece behind it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .tokens import _RISKY, IDS_OF_PIECE, MOST_PIECES, BatchEncoder

#: Texts that sentencepiece gets whole: a space at an end or next to another, or the sign that stands for a space.
_RISKY_MODEL = r"^ | $|  |\x{2581}"


class _Model(BatchEncoder):
    """The remembering of BatchEncoder for a sentencepiece file. The library puts a space before what it is given."""

    def __init__(self, path: str, most: int = MOST_PIECES):
        from sentencepiece import SentencePieceProcessor

        self.library, self.most, self.added, self.spaced = SentencePieceProcessor(model_file=path), most, set(), True
        names = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        self.cuttable = not any("▁" in x.lstrip("▁") for x in names)
        self._forget()

    def _library_ids(self, texts: list[str], added: bool = False) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def _together(self, pieces: list[str]) -> None:
        self._singly(pieces)


class PieceEncoder:
    """Pieces of texts, and the ids of each. plain: strings of added tokens are ordinary text."""

    def __init__(self, path: str, most: int = MOST_PIECES, plain: bool = False):
        self.model = path.endswith(".model")
        self.codes = _Model(path, most) if self.model else BatchEncoder(path, most)
        self.plain = plain or self.model
        self.starts = set() if self.plain else self.codes.added

    def _room(self) -> None:
        codes = self.codes
        if len(codes.slots) > codes.most or codes.used > IDS_OF_PIECE * codes.most:
            codes._tidy()

    def inseparable(self, texts: pa.Array) -> np.ndarray:
        """Which texts have to be encoded whole."""
        mask = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
        if self.model:
            return mask(pc.match_substring_regex(texts, _RISKY_MODEL)) if self.codes.cuttable else np.ones(len(texts), bool)
        out = mask(pc.match_substring_regex(texts, _RISKY)) if self.codes.spaced else np.zeros(len(texts), bool)
        for start in self.starts:
            out = out | mask(pc.match_substring(texts, start, ignore_case=start[:1].isalpha()))
        return out

    def whole_ids(self, texts: list[str]) -> list[list[int]]:
        return self.codes._library_ids(texts, not self.plain)

    def split(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, pa.Array | None]:
        """(pieces, their offsets by text, the first piece of each text where no space goes before it)."""
        lists = pc.split_pattern(texts, " ") if self.codes.spaced else pc.ascii_split_whitespace(pc.ascii_lower(texts))
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        opening = flat.take(pa.array(offsets[:-1])) if self.codes.spaced and not self.model else None
        return flat.dictionary_encode(), offsets, opening

    def slots_of(self, pieces: list[str]) -> np.ndarray:
        """Where the ids of distinct pieces are remembered, until the next call."""
        self._room()
        return self.codes._find([" " + x for x in pieces] if self.codes.spaced and not self.model else pieces)

    def sizes_of(self, pieces: list[str]) -> np.ndarray:
        slots = self.slots_of(pieces)  # which may replace the arrays
        return self.codes.sizes[slots].astype(np.int64)

    def opening_sizes(self, pieces: pa.Array) -> np.ndarray:
        """Tokens of first pieces, which no space goes before."""
        slots = self.codes._find(pieces.to_pylist(), True)
        return self.codes.sizes[slots].astype(np.int64)

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id."""
        library = self.codes.library
        if self.model:
            names = [library.id_to_piece(k) for k in range(library.get_piece_size())]
            return [bytes([int(x[3:5], 16)]) if library.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(names)]
        signs = _byte_signs()
        vocabulary = library.get_vocab()
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            out[k] = bytes(map(signs.__getitem__, token)) if all(x in signs for x in token) else token.encode()
        return out


def _byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: itself if it can be seen in Latin-1, else 256 and on."""
    seen = [b for b in range(256) if re.match(r"[!-~\xa1-\xac\xae-\xff]", chr(b))]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}
