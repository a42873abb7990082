"""Token ids of whole texts, from a public tokenizer's file, with a cache of pieces.

A text is cut where the tokenizer always begins a new piece; each distinct piece is
encoded once by the tokenizers library, and a document's ids are gathered from the
pieces'. The cuts are exact (tests compare with the library on whole texts):

* "prefix" (byte-level BPE whose pieces take one leading space): before every single
  space that stands between two characters that are not white space;
* "drop" (vocabularies of words, white space dropped): at ASCII white space.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np

#: Distinct pieces kept at once by a worker; beyond that the cache starts anew.
MOST_PIECES = 800_000
#: Pieces that go to the library as one text ("drop": ASCII ones alone).
TOGETHER = 64
#: White space but the space and the line feed.
_OTHER = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_CUT = re.compile(r"(?<=\S) (?=\S)")


class _Index(dict):
    def __init__(self):
        self.new: list = []

    def __missing__(self, key):
        n = self[key] = len(self)
        self.new.append(key)
        return n


class Encoder:
    def __init__(self, path: str, cut: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.cut = {"prefix": self._prefix, "drop": self._drop}[cut]
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # of tokens, in characters: bytes, where it is byte-level
        self.sizes[list(vocabulary.values())] = list(map(len, vocabulary))
        self._start_anew()

    def _start_anew(self) -> None:
        self.index, self.ids, self.starts, self.lengths = _Index(), np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = self.pieces = 0

    @staticmethod
    def _prefix(text: str) -> list:
        if not text:
            return []
        # Where no space has white space beside it, cutting at all spaces is the same, and faster.
        plain = "  " not in text and " \n" not in text and "\n " not in text and text[0] != " " and text[-1] != " " and not any(c in text for c in _OTHER)
        parts = text.split(" ") if plain else _CUT.split(text)
        parts[0] = (parts[0],)  # without the space that all others begin with
        return parts

    @staticmethod
    def _drop(text: str) -> list:
        return text.encode("utf-8", "surrogatepass").split()

    @staticmethod
    def _text(piece) -> str:
        return piece[0] if isinstance(piece, tuple) else piece.decode("utf-8", "replace") if isinstance(piece, bytes) else " " + piece

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        while self.pieces + len(new) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        if self.cut == self._drop:
            fit, together = [x.isascii() for x in new], self._joined
        else:  # a space and, at both ends, what is not white space: side by side, each is cut off again
            fit, together = [isinstance(x, str) and x != "" and not (x[0].isspace() or x[-1].isspace()) for x in new], self._in_rows
        for some, encode in (([i for i, x in enumerate(fit) if x], together), ([i for i, x in enumerate(fit) if not x], self._alone)):
            for i in range(0, len(some), 4096):
                ids, lengths = encode([new[x] for x in some[i : i + 4096]])
                while self.used + len(ids) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
                at = self.pieces + np.array(some[i : i + 4096], np.int64)
                self.ids[self.used : self.used + len(ids)] = ids
                self.starts[at] = self.used + np.cumsum(lengths) - lengths
                self.lengths[at] = lengths
                self.used += len(ids)
        self.pieces += len(new)

    def _alone(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, and how many each has."""
        each = [e.ids for e in self.tokenizer.encode_batch_fast([self._text(x) for x in pieces], add_special_tokens=False)]
        lengths = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(itertools.chain.from_iterable(each), np.uint32, int(lengths.sum())), lengths

    def _in_rows(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """The same, TOGETHER in a text, each behind its space: byte-level tokens have a character for each byte, so that
        their sizes tell where a piece ends. Where they don't end there, each piece is encoded alone."""
        rows = [" " + " ".join(pieces[i : i + TOGETHER]) for i in range(0, len(pieces), TOGETHER)]
        each = [e.ids for e in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(each), np.uint32, sum(map(len, each)))
        ends = np.cumsum(self.sizes[ids])
        wanted = np.cumsum([1 + (len(x) if x.isascii() else len(x.encode())) for x in pieces])
        upto = np.searchsorted(ends, wanted)
        if not len(ids) or ends[-1] != wanted[-1] or (ends[upto] != wanted).any():
            return self._alone(pieces)
        return ids, np.diff(upto + 1, prepend=0)

    def _joined(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """The same, TOGETHER in a text with spaces between: a token is of the piece that its first character is in."""
        lengths, ids = np.zeros(len(pieces), np.int64), []
        for i in range(0, len(pieces), TOGETHER):
            some = pieces[i : i + TOGETHER]
            got = self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False)
            ids += got.ids
            begins = np.cumsum([len(x) + 1 for x in some])  # of the pieces after each
            of = np.searchsorted(begins, [a for a, _ in got.offsets], "right")
            lengths[i : i + len(some)] = np.bincount(of, minlength=len(some))
        return np.array(ids, np.uint32), lengths

    def encode(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        """The ids of each text (null: empty), each followed by end."""
        out: list[np.ndarray] = []
        take = self.index.__getitem__
        i = 0
        while i < len(texts):
            pieces, counts, chars = [], [], 0
            while i < len(texts) and chars < 1 << 20:  # about so many characters at once, a longer text alone
                text = texts[i] or ""
                found = self.cut(text)
                pieces += found
                counts.append(len(found))
                chars += len(text) + 1
                i += 1
            at = np.fromiter(map(take, pieces), np.int64, len(pieces))
            self._learn()
            lengths = self.lengths[at]
            before = np.concatenate([[0], np.cumsum(lengths)])
            flat = self.ids[np.repeat(self.starts[at] - before[:-1], lengths) + np.arange(before[-1])] if len(at) else self.ids[:0]
            edges = before[np.concatenate([[0], np.cumsum(counts)])]
            out += [np.append(flat[a:b], np.uint32(end)) for a, b in zip(edges, edges[1:])]
            if self.pieces > MOST_PIECES:
                self._start_anew()
                take = self.index.__getitem__
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, cut: str) -> Encoder:
    """One for each worker process, with what it has cached."""
    if (path, cut) not in _ENCODERS:
        _ENCODERS[path, cut] = Encoder(path, cut)
    return _ENCODERS[path, cut]
