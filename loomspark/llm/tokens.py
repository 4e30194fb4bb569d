"""Whole texts to token ids with the tokenizers library, each distinct word encoded once for a worker.

Texts are cut only where the tokenizer's own pre-tokenizer always cuts, so that the ids of the parts, joined, are the
ids of the whole text:

* "words": a vocabulary that drops white space; any ASCII white space is such a place.
* "bytes": a byte-level vocabulary whose words carry one leading space; before a lone space between two characters
  that aren't white space, and on both sides of a lone line feed.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

_DOUBLE = re.compile(r"\s\s")
_SAFE = re.compile(r"(?<=\S)(?= \S)")
# Letters up to U+00FF, then ASCII punctuation but the apostrophe: two pre-tokens under every split rule in use here.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
_STOPS = frozenset(".,;:!?")
_CODECS: dict[tuple[str, str], "Codec"] = {}


def _byte_letters() -> dict[int, str]:
    """Byte to the letter that byte-level vocabularies write for it: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def _packed(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


class Memo(dict):
    """Words to the bytes of their ids. Holds at most `most` words; begins anew where too many others turn up."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.others = encode, most, 0

    def join(self, words: list) -> bytes:
        out = list(map(self.get, words))
        try:
            return b"".join(out)
        except TypeError:
            pass
        encode, room = self.encode, self.most - len(self)
        for i, ids in enumerate(out):
            if ids is None:
                w = words[i]
                out[i] = ids = encode(w)
                if room > 0:
                    self[w] = ids
                    room -= 1
                else:
                    self.others += 1
        if self.others > 16 * self.most:
            self.clear()
            self.others = 0
        return b"".join(out)

    def other(self, word) -> bytes:
        ids = self.encode(word)
        if len(self) < self.most:
            self[word] = ids
        else:
            self.others += 1
            if self.others > 16 * self.most:
                self.clear()
                self.others = 0
        return ids


class Codec:
    """Ids of whole texts. kind: "words" or "bytes", as above."""

    def __init__(self, path: str, kind: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.model = self.tokenizer.model
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        if any(_PLAIN.fullmatch(t) for t in special):
            raise ValueError("a special token that is a plain word isn't supported")
        self.runs = Memo(self._run, most)  # letters or punctuation, as the vocabulary writes them
        self.bare = Memo(self._word, most)
        self.spaced = Memo(lambda w: self._word(w, " "), most)
        self.line_feed = self._full("\n")

    def _full(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _run(self, run: str) -> bytes:
        return _packed([t.id for t in self.model.tokenize(run)])

    def _word(self, word: str | bytes, space: str = "") -> bytes:
        """A word that isn't plain goes through the whole tokenizer. A plain one is two runs: their letters are stable under
        composition, lower-case one by one, and are looked up in the model as the vocabulary writes their bytes."""
        w = word if word.__class__ is str else word.decode("utf-8", "replace")
        letters, marks = w, ""
        if not w.isalpha():
            letters, marks = w[:-1], w[-1:]
            if marks not in _STOPS or not letters.isalpha():
                found = _PLAIN.fullmatch(w)
                if not found:
                    return self._full(space + w)
                letters, marks = found.groups()
        if self.kind == "words":
            letters = letters.lower()
        if letters.isascii():
            if space:
                letters = "\u0120" + letters
        else:
            try:
                letters.encode("latin-1")  # what lies beyond may compose or change its length with its case
            except UnicodeEncodeError:
                return self._full(space + w)
            letters = (space + letters).encode().decode("latin-1").translate(_LETTERS)
        runs = self.runs
        ids = runs.get(letters)
        if ids is None:
            ids = runs.other(letters)
        return ids + (runs.get(marks) or runs.other(marks)) if marks else ids

    def ids(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.kind == "words":
            return self.bare.join(text.split())
        s = text.decode("utf-8", "replace")
        if _DOUBLE.search(s):
            return self.bare.join(_SAFE.split(s))
        lines = []
        for line in s.split("\n"):
            first, *words = line.split(" ")
            lines.append(self.bare.join([first]) + self.spaced.join(words))
        return self.line_feed.join(lines)


def codec(path: str, kind: str) -> Codec:
    """One for each worker process and vocabulary."""
    if (path, kind) not in _CODECS:
        _CODECS[path, kind] = Codec(path, kind)
    return _CODECS[path, kind]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
