"""Token ids of whole texts, piece by piece and from a bounded cache.

``PieceEncoder`` gives exactly the ids of the ``tokenizers`` library. It cuts a text at
places where the library's own pre-tokenizer always starts a new unit, whatever stands
around them, has the library encode each distinct piece once, and joins the ids:

* byte-level vocabularies: before the last space of white space that a word follows, or
  before the word if that white space ends otherwise. The rest of the white space is one
  unit, or its last character is one of its own where the word takes no space.
* word vocabularies (they have a normalizer, and white space is dropped): at ASCII white space.

A plain piece, Latin letters and then signs, goes straight to the library's model as one
or two units; any other piece goes through the whole library. So does a whole text that
holds one of the vocabulary's special strings, or, for byte-level vocabularies, white
space outside ASCII.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import U64, Words

#: Letters, then other signs: two units of either vocabulary's pre-tokenizer (an apostrophe may start a contraction).
_PLAIN = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b if b in shown else next(hidden)) for b in range(256)}


_LETTERS = _byte_letters()
#: UTF-8 of white space other than U+0020 and U+0009..U+000D, and of control characters that may count as such.
_ODD_BYTES = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\x1c", b"\x1d", b"\x1e", b"\x1f")
_ODD = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f]")


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder(dict):
    """ids(text) as ``tokenizers`` gives them with add_special_tokens=False.

    As a dict it holds the ids (as bytes) of the pieces seen. When it is full, all but the
    pieces of the present texts are forgotten. Words are grouped by hash and then compared
    byte by byte, so ids never depend on a hash.
    """

    limit = 900_000
    _loaded: dict[tuple[str, bool], PieceEncoder] = {}

    def __init__(self, path: str, special: bool = True):
        """special: whether special strings inside texts become their ids, as is the library's default."""
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        self.by_word = own.get("normalizer") is not None
        self.special = [x["content"] for x in own["added_tokens"]] if special else []
        self.library.encode_special_tokens = not special
        self.dtype = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.library.no_truncation()
        self.library.no_padding()
        self.signs: dict[str, bytes] = {}

    @staticmethod
    def suits(path: str) -> bool:
        """Whether a vocabulary's pre-tokenizer is one of the two whose cuts are known here."""
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        pre, normal = own.get("pre_tokenizer") or {}, own.get("normalizer")
        if own["model"].get("type", "BPE") != "BPE" or own["model"].get("dropout"):
            return False
        if normal is None:
            return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        steps = [x["type"] for x in normal.get("normalizers", [])]
        return steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]

    @classmethod
    def of(cls, path: str, special: bool = True) -> PieceEncoder:
        """One encoder for each file and Python process."""
        if (path, special) not in cls._loaded:
            cls._loaded[path, special] = cls(path, special)
        return cls._loaded[path, special]

    def _unit(self, unit: str) -> bytes:
        """The ids of one unit of the pre-tokenizer, from the library's model alone."""
        letters = unit.replace(" ", "Ġ") if unit.isascii() else unit.encode().decode("latin-1").translate(_LETTERS)
        return array(self.code, [x.id for x in self.model.tokenize(letters)]).tobytes()

    def _piece(self, piece: bytes) -> bytes:
        """The ids of a word, which its space may precede."""
        text = piece.decode("utf-8", "surrogatepass")
        if text.isascii() and text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return self._unit(text.lower() if self.by_word else text)
        if plain := _PLAIN.fullmatch(text):
            lead, word, signs = plain.groups()
            if signs and signs not in self.signs:
                self.signs[signs] = self._unit(signs)
            known = self.get(piece[: -len(signs)]) if signs else None  # signs are ASCII
            return (known or self._unit(lead + (word.lower() if self.by_word else word))) + (self.signs[signs] if signs else b"")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        ids, counts = self.many(texts)
        yield from np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else ()

    def _space(self, run: bytes, word_has_space: bool, last: bool) -> bytes:
        """The ids of white space: before a word that takes the last space itself, before one that doesn't, or at the end."""
        unit = lambda x: array(self.code, [t.id for t in self.model.tokenize(x.decode("latin-1").translate(_LETTERS))]).tobytes() if x else b""
        return unit(run) if word_has_space or last else unit(run[:-1]) + unit(run[-1:])

    def many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of each text's ids.

        Each distinct word of the texts is looked up once; ids are put together by index.
        """
        w = Words(texts)
        whole = [i for i, t in enumerate(texts) if t and any(s in t for s in self.special)] if any(s.encode() in w.raw for s in self.special) else []
        if not self.by_word and any(x in w.raw for x in _ODD_BYTES):
            whole = sorted({*whole, *(i for i, t in enumerate(texts) if t and _ODD.search(t))})
        if whole:
            special = {i: np.array(self.library.encode(texts[i], add_special_tokens=False).ids, self.dtype) for i in whole}
            ids, counts = self.many([None if i in special else t for i, t in enumerate(texts)])
            parts = np.split(ids, np.cumsum(counts)[:-1])
            parts = [special.get(i, p) for i, p in enumerate(parts)]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        n, raw = len(w.hash), w.raw
        a = np.frombuffer(raw, np.uint8)
        spaced = np.zeros(n, bool)
        inner = w.start > 0
        spaced[inner] = a[w.start[inner] - 1] == 32
        key = w.hash if self.by_word else w.hash ^ (spaced.astype(U64) * U64(0xA0761D6478BD642F))
        index = pa.array(key).dictionary_encode().indices.to_numpy().astype(np.int64)  # numbered by first place
        some = np.flatnonzero(np.diff(np.maximum.accumulate(index), prepend=-1))
        first = some[index]
        if not (w.same(first, np.arange(n)) & (self.by_word | (spaced[first] == spaced))).all():  # equal hashes of different pieces
            known: dict[bytes, int] = {}
            index = np.array([known.setdefault(raw[a:z], len(known)) for a, z in zip((w.start - (0 if self.by_word else spaced)).tolist(), w.end.tolist(), strict=True)], np.int64)
            some = np.unique(index, return_index=True)[1]
        from_ = w.start[some] if self.by_word else w.start[some] - spaced[some]
        pieces = [raw[a:z] for a, z in zip(from_.tolist(), w.end[some].tolist(), strict=True)]
        items = list(map(self.get, pieces))
        new = [i for i, x in enumerate(items) if x is None]
        for i in sorted(new, key=pieces.__getitem__):  # a word comes before itself with signs
            items[i] = self[pieces[i]] = self._piece(pieces[i])
        if len(self) > self.limit:
            self.clear()
            self.signs.clear()
            self.update(zip(pieces, items, strict=True))
        ends = np.cumsum(w.counts)
        sizes = w.sizes
        begin = np.cumsum(sizes + 1) - sizes - 1
        order, doc = index, np.repeat(np.arange(len(texts)), w.counts)
        if not self.by_word:
            # White space that is no word's own space, before words and at the ends of texts.
            before = np.empty(n, np.int64)
            before[1:] = w.end[:-1]
            first = (ends - w.counts)[w.counts > 0]
            before[first] = begin[w.counts > 0]
            gap = w.start - before - spaced
            at = np.flatnonzero(gap > 0)
            last = np.where(w.counts > 0, np.concatenate([[0], w.end])[ends], begin)
            tail = np.flatnonzero(begin + sizes > last)
            runs: dict[tuple[bytes, bool, bool], int] = {}
            number = []
            for x, k, sp in zip(before[at].tolist(), gap[at].tolist(), spaced[at].tolist(), strict=True):
                number.append(runs.setdefault((raw[x : x + k], sp, False), len(runs)))
            for x, z in zip(last[tail].tolist(), (begin + sizes)[tail].tolist(), strict=True):
                number.append(runs.setdefault((raw[x:z], False, True), len(runs)))
            if number:
                items += [self._space(*k) for k in runs]
                number = np.array(number, np.int64) + len(pieces)
                place = np.concatenate([at, ends[tail]])
                owner = np.concatenate([doc[at], tail])
                # A text's end comes before the next text's first word, and before its white space.
                rank = np.lexsort((np.concatenate([np.ones(len(at), int), np.zeros(len(tail), int)]), owner, place))
                order = np.insert(index, place[rank], number[rank])
                doc = np.insert(doc, place[rank], owner[rank])
        joined = pa.array(items, pa.large_binary()).take(pa.array(order))
        at = np.frombuffer(joined.buffers()[1], np.int64, len(order) + 1) // self.dtype.itemsize if len(order) else np.zeros(1, np.int64)
        ids = np.frombuffer(joined.buffers()[2], self.dtype, int(at[-1])) if at[-1] else np.empty(0, self.dtype)
        return ids, np.diff(at[np.searchsorted(doc, np.arange(len(texts) + 1))])


class WordEncoder(PieceEncoder):
    """The ids of words (bytes without white space), each after a space; special strings are ordinary text."""

    limit = 250_000
    _loaded: dict = {}

    def __init__(self, path: str, special: bool = False):
        super().__init__(path, special)
        vocabulary = self.library.get_vocab()
        self.end = max(vocabulary.values())
        #: Whether an id begins a word (or is the end id).
        self.begins = np.zeros(self.end + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("Ġ") or i == self.end]] = True

    def __missing__(self, word: bytes) -> bytes:
        out = self[word] = self._piece(b" " + word)
        return out

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), self.dtype)

    def forget(self, but: list[bytes]) -> None:
        """Once the limit is passed, keep only these words."""
        if len(self) > self.limit:
            here = {x: self[x] for x in but}
            self.clear()
            self.update(here)
