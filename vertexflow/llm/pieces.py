"""Exact token ids by a table of space-separated pieces.

Both public vocabularies split a text before a space that follows a visible
character, so a piece encodes the same alone as in its text. Arrow splits texts and
finds the distinct pieces of a batch; each of these goes through the tokenizers
library once per worker and query. Texts where the split is not provably a token
boundary (white space of two or more, NUL) go through it whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker keeps; beyond, it only looks up, and starts anew once as many have missed.
CACHE = 900_000
#: UTF-8 bytes of the texts that Arrow splits at once (one text is never cut).
BATCH_BYTES = 16 << 20
#: Words that go through the library as one text.
JOINED = 1024

_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE = rf"{_SPACE}{_SPACE}|\x00"
_MARKS = ".,;:!?"


def load(path: str):
    """The tokenizer of a ``.json`` vocabulary file, held to one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def sized_batches(batch, column: int = 1, most: int | None = None):
    """Slices of an Arrow batch by the bytes of a text column, a row at least."""
    most = BATCH_BYTES if most is None else most
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).cumsum()
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end


class PieceEncoder:
    """Encode whole texts as ids, the bytes of an array of ``kind``."""

    def __init__(self, path: str, drops_space: bool, kind: str, most: int | None = None):
        self.tokenizer = load(path)
        self.most = CACHE if most is None else most
        self.drops_space, self.kind = drops_space, kind
        self.known: dict[str, bytes] = {}
        self.missed = 0
        self._letters: dict[str, bool] = {}
        vocabulary = self.tokenizer.get_vocab()
        #: Tokens that end a word, or else those that start with its space.
        self.edge = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.endswith("</w>") if drops_space else t.startswith("Ġ"))]] = True

    def values(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text."""
        data, ends, at, whole = self._batch(texts)
        out = [b""] * len(texts)
        start = 0
        for i, end in zip(at, ends):
            out[i] = data[start:end]
            start = end
        for i, x in whole:
            out[i] = x
        return out

    def _batch(self, texts: pa.Array):
        """(values of all split texts one after another, their ends, their places, (place, value) of the others)."""
        texts = pc.fill_null(texts, "")
        if self.drops_space:
            at, rest = np.arange(len(texts)), []
            split = pc.replace_substring(texts, "\n", " ")
            pieces = pc.split_pattern(split, " ")
        else:
            unsafe = np.asarray(pc.match_substring_regex(texts, _UNSAFE))
            at, odd = np.flatnonzero(~unsafe), np.flatnonzero(unsafe)
            rest = list(zip(odd.tolist(), self._encode_all(texts.take(pa.array(odd)).to_pylist())))
            split = pc.replace_substring(pc.replace_substring(texts.take(pa.array(at)), "\n", "\x00\n"), " ", "\x00 ")
            pieces = pc.split_pattern(split, "\x00")
        bounds = np.asarray(pieces.offsets) - (pieces.offsets[0].as_py() if len(pieces.offsets) else 0)
        coded = pieces.flatten().dictionary_encode()
        found = self._known(coded.dictionary.to_pylist())
        data, ends = self._gather(found, np.asarray(coded.indices), bounds)
        return data, ends, at.tolist(), rest

    def _gather(self, found: list[bytes], places: np.ndarray, bounds: np.ndarray):
        """The values at ``places`` one after another, and where each text ends."""
        taken = pa.array(found, pa.binary()).take(pa.array(places))
        offsets = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, taken.offset * 4) if len(taken) else np.zeros(1, np.int32)
        data = taken.buffers()[2].to_pybytes() if len(taken) and taken.buffers()[2] is not None else b""
        return data, offsets[bounds[1:]].tolist() if len(bounds) else []

    def _known(self, pieces: list[str]) -> list:
        """Values of distinct pieces, by the table or else the library."""
        get = self.known.get
        out = [get(p) for p in pieces]
        new = [i for i, x in enumerate(out) if x is None]
        if new:
            words = [pieces[i] for i in new]
            values = self._encode(words)
            for i, x in zip(new, values):
                out[i] = x
            if len(self.known) + len(new) <= self.most:
                self.known.update(zip(words, values))
            else:
                self.missed += len(new)
                if self.missed > self.most:
                    self.known, self.missed = {}, 0
        return out

    def _encode(self, pieces: list[str]) -> list:
        """Values of new pieces; a line end before a word and marks after it are tokens of their own, so only new words reach the library."""
        plain = [self._plain(p) for p in pieces]
        words = [p for p, x in zip(pieces, plain) if x]
        values = self._encode_all(words)
        if len(words) == len(pieces):
            return values
        known, fresh = self.known, dict(zip(words, values))
        parts = [self._parts(p) for p, x in zip(pieces, plain) if not x]
        new = list({x for p in parts for x in p if x not in fresh and x not in known})
        fresh.update(zip(new, self._encode_all(new)))

        def value(x):
            y = fresh.get(x)
            return known[x] if y is None else y

        odd = iter([value(p[0]) if len(p) == 1 else self.joined([value(x) for x in p]) for p in parts])
        whole = iter(values)
        return [next(whole) if x else next(odd) for x in plain]

    def _plain(self, piece: str) -> bool:
        """A word that is its only part: letters, in lower case where case goes, after a space where spaces count."""
        return piece.isalpha() and piece.islower() and piece.isascii() if self.drops_space else piece[:1] == " " and piece[1:].isalpha()

    joined = staticmethod(b"".join)

    def _parts(self, piece: str) -> tuple[str, ...]:
        word = piece.rstrip(_MARKS)
        if not word:
            return (piece,)
        last = word[-1]
        if not last.isalpha() or not (last.isascii() or self._stays_letter(last)):
            return (piece,)
        tail = (piece[len(word) :],) if len(word) < len(piece) else ()
        if self.drops_space:
            return (word.lower() if word.isascii() else word, *tail)
        if word[0] == "\n" and word[1:2].isalpha():
            return ("\n", word[1:], *tail)
        return (word, *tail)

    def _stays_letter(self, c: str) -> bool:
        """Whether the normal form of a letter ends in a letter; after a mark, what follows belongs to the same token."""
        if c not in self._letters:
            normal = self.tokenizer.normalizer.normalize_str(c) if self.tokenizer.normalizer else c
            self._letters[c] = normal[-1:].isalpha()
        return self._letters[c]

    def _encode_all(self, texts: list[str]) -> list[bytes]:
        """Words of letters go to the library many at once and are told apart by their edges; all else goes alone."""
        skip = 0 if self.drops_space else 1
        plain = [t.isalpha() if self.drops_space else t[:1] == " " and t[1:].isalpha() for t in texts]
        words, out = [t for t, x in zip(texts, plain) if x], []
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, e in zip(groups, self._library([("" if skip else " ").join(g) for g in groups])):
            ids = np.array(e.ids, self.kind)
            at = np.flatnonzero(self.edge[ids])
            if len(at) == len(group):  # each word has one edge at least, so here each has one
                at = (np.append(at, len(ids)) if skip else np.append(0, at + 1)) * ids.itemsize
                at, raw = at.tolist(), ids.tobytes()
                out += [raw[i:j] for i, j in zip(at, at[1:])]
            else:
                out += [np.array(x.ids, self.kind).tobytes() for x in self._library(group)]
        if len(words) == len(texts):
            return out
        rest = iter([np.array(e.ids, self.kind).tobytes() for e in self._library([t for t, x in zip(texts, plain) if not x])])
        whole = iter(out)
        return [next(whole) if x else next(rest) for x in plain]

    def _library(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []


@lru_cache(maxsize=1)
def encoder(path: str, drops_space: bool, kind: str, query: str, most: int | None = None) -> PieceEncoder:
    """The Python worker's encoder, which keeps its pieces between tasks of one query, ``most`` of them (``CACHE``)."""
    return PieceEncoder(path, drops_space, kind, most)
