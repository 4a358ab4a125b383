"""Token ids of whole texts by a public tokenizer, each distinct piece of a batch encoded once.

Both byte-pair vocabularies look at one run of letters or of marks at a time, with the blank before
it.  So a text can be cut at a blank or line feed that stands alone between two solid characters, and
between a letter and a mark, without changing any id.  Texts repeat their words: a batch is cut into
such pieces, the pieces are numbered, and the tokenizer encodes each distinct one.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sievework.llm import texts as tx

#: Text bytes whose pieces are looked up together, and how many pieces a worker remembers: both bound its memory.
BATCH_BYTES = 2_000_000
REMEMBERED = 200_000
#: New words that the tokenizer's model splits at once.
TOGETHER = 64

_encoders: dict[tuple[str, bool], Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str, words_only: bool):
        """``words_only``: the vocabulary ignores white space and case."""
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        #: Strings that the tokenizer takes for one id wherever they stand; texts with one are encoded in one piece.
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.model = self.whole.model
        self.words_only = words_only
        self.letters = _byte_letters()
        self.shown = np.array([ord(self.letters[b]) for b in range(256)], "<u4")
        #: Whether no id can hold a blank after a letter (but for hard blanks), so that words in a row stay apart; ids that start with one.
        vocab = self.whole.get_vocab()
        blank, hard = self.letters[32], self.letters[0xC2] + self.letters[0xA0]
        self.apart = not words_only and vocab.keys() >= set(self.letters.values()) and all(blank not in v[1:] or hard in v for v in vocab)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for v, i in vocab.items() if v.startswith(blank)]] = True
        self.known: dict[bytes, bytes] = {}
        self.remembered = REMEMBERED

    def cuts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where pieces start: row starts, lone blanks and line feeds, what follows these, and marks after letters."""
        if not len(data):
            return np.zeros(0, np.int64)
        full = at[:-1] < at[1:]
        heads, tails = at[:-1][full], at[1:][full] - 1
        solid = data - np.uint8(33) < 94
        before = np.zeros(len(data), bool)
        before[1:] = solid[:-1]
        # a character of two bytes, none of which is white space after the lead 0xC2
        before[2:] |= (data[1:-1] >= 0x80) & (data[:-2] - np.uint8(0xC3) < 29)
        two = heads[heads < tails] + 1  # the byte before the row's second one must be whole
        before[two] = solid[two - 1]
        before[heads] = False
        after = np.zeros(len(data), bool)
        after[:-1] = solid[1:] | ((data[1:] >= 0xC3) & (data[1:] - np.uint8(0xE1) >= 3))
        after[tails] = False
        alone = before & after
        feed = alone & (data == 10)
        letter = (data | np.uint8(32)) - np.uint8(97) < 26
        cut = feed | (alone & (data == 32))
        cut[1:] |= feed[:-1] | (letter[:-1] & solid[1:] & ~letter[1:] & (data[1:] - np.uint8(48) >= 10))
        cut[heads] = True
        return np.flatnonzero(cut)

    def pretoken(self, text: str) -> list[int]:
        return [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.letters))]

    def piece(self, piece: bytes) -> bytes:
        if piece[1:].isalpha() and piece[0] == 32:  # a blank and ASCII letters, by far most pieces
            word = piece[1:].lower().decode() if self.words_only else "\u0120" + piece[1:].decode()
            return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        text = piece.decode("utf-8", "replace")
        body = text[1:] if text[:1] == " " else text
        if body.isalpha() and max(body) < "\u0100":
            ids = self.pretoken(body.lower() if self.words_only else text)
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def is_word(self, piece: bytes) -> bool:
        """Whether a piece is a blank and letters of a byte or two."""
        if piece[0] != 32 or len(piece) == 1:
            return False
        text = piece[1:].decode("utf-8", "replace")
        return text.isalpha() and max(text) < "\u0100"

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece; words go to the tokenizer's model many at once, where none can grow together."""
        if not self.apart:
            return list(map(self.piece, pieces))
        words = [p for p in pieces if self.is_word(p)]
        ids: list[int] = []
        for a in range(0, len(words), TOGETHER):
            data = np.frombuffer(b"".join(words[a : a + TOGETHER]), np.uint8)
            ids += [t.id for t in self.model.tokenize(self.shown[data].tobytes().decode("utf-32-le"))]
        flat = np.array(ids, "<u4")
        begin = np.append(np.flatnonzero(self.opens[flat]), len(flat)) * 4
        raw, begin = flat.tobytes(), begin.tolist()
        of = dict(zip(words, (raw[a:b] for a, b in zip(begin, begin[1:])), strict=True))  # noqa: B905, RUF007
        return [of[p] if p in of else self.piece(p) for p in pieces]

    def look_up(self, pieces: list[bytes]) -> list[bytes]:
        known = self.known
        out = list(map(known.get, pieces))
        new = [i for i, got in enumerate(out) if got is None]
        for i, got in zip(new, self.pieces([pieces[i] for i in new]), strict=True):
            out[i] = got
        if len(known) + len(new) > self.remembered:
            known.clear()  # but for what this batch holds
            new = range(len(pieces))
        for i in new[: self.remembered]:
            if len(pieces[i]) <= 64:
                known[pieces[i]] = out[i]
        return out

    def _uncut(self, texts: pa.Array) -> np.ndarray:
        """The texts that hold a special string, in whatever case."""
        out = np.zeros(len(texts), bool)
        for special in self.special:
            out |= pc.match_substring(texts, special.encode(), ignore_case=True).to_numpy(zero_copy_only=False)
        return out

    def _pieces(self, texts: pa.Array):
        data, at = tx.raw(texts)
        cut = self.cuts(data, at)
        uncut = self._uncut(texts)
        if uncut.any():
            row = np.searchsorted(at, cut, "right") - 1
            cut = cut[~uncut[row] | (cut == at[row])]
        numbered = tx.binary(data, np.append(cut, len(data))).dictionary_encode()
        ids = self.look_up(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        return ids, numbered.indices, np.searchsorted(cut, at)

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        ids, which, first = self._pieces(texts)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return tx.sums(size[which.to_numpy()], first)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text starts (one more for the end)."""
        ids, which, first = self._pieces(texts)
        data, at = tx.raw(pa.array(ids, pa.large_binary()).take(which))
        return data.view("<u4"), at[first] // 4


def encoder(path: str, words_only: bool = False, remembered: int = REMEMBERED) -> Encoder:
    """The worker's encoder for a vocabulary file, which remembers ``remembered`` pieces at least; it outlives a task."""
    if (path, words_only) not in _encoders:
        _encoders[path, words_only] = Encoder(path, words_only)
    found = _encoders[path, words_only]
    found.remembered = max(found.remembered, remembered)
    return found
