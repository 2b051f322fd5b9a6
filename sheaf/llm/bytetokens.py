"""Byte-level BPE ids through the tokenizers library, with a cache of words.

The tokenizer's pre-tokenizer always starts a new unit at a space that stands between two
characters that are not white space, and no merge crosses a unit. A text may therefore be
cut at such spaces and its pieces encoded apart; a piece met before is taken from the
cache. Texts with other white space around a space are cut with more care. A new word of
common letters, digits, punctuation and line ends is cut into its units, and units not met
before go straight to the library's merge model; any other new word goes to the whole
tokenizer. Words longer than ``CACHED`` characters are not kept, so the caches are bounded
in bytes as well as in words.

All of this holds for one kind of tokenizer, and its file says whether it is one: no
normalizer, the byte-level pre-tokenizer with its own pattern and no prefix space, plain
BPE. Texts of any other tokenizer go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

import numpy as np

from sheaf.llm import workercache

#: Longest word, in characters, that a cache keeps.
CACHED = 64
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Words whose units the tokenizer's own pattern finds without doubt about the Unicode version.
_COMMON = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ!-~\n]+")
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ɏ]", r"[!-&(-/:-@\[-`{-~]"
#: Of them, letters and then marks, and perhaps the same again after a line end: each run is a unit.
_PLAIN = re.compile(f"({_LETTERS}+)({_MARKS}+)?(?:\n({_LETTERS}+)({_MARKS}+)?)?")
#: What added tokens must not look like for no such word to hold one.
_INSIDE_PLAIN = re.compile(f"{_LETTERS}*{_MARKS}*(?:\n{_LETTERS}*{_MARKS}*)?")


def is_byte_level(path: str) -> bool:
    """Whether the tokenizer file is of the kind that may be cut at spaces."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    cut, model = data.get("pre_tokenizer") or {}, data.get("model") or {}
    plain_model = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    plain_cut = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    return data.get("normalizer") is None and plain_cut and plain_model and not data.get("truncation") and not data.get("padding")


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters for themselves, the others by the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class ByteTokens:
    """Encodes texts to little-endian unsigned 32-bit ids.

    ``cache_words`` bounds a generation of cached words; two generations are kept. A null
    text is encoded like an empty one: no ids.
    """

    def __init__(self, path: str, cache_words: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.cuts = is_byte_level(path)
        self.units_of = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.letters = {b: c for b, c in enumerate(_byte_letters())}
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.packed = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]
        self.plain = not any(_INSIDE_PLAIN.fullmatch(a) for a in added)
        self.limit = cache_words
        self.heads: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _unit(self, unit: str) -> bytes:
        if unit.isascii() and unit[-1] != "\n":
            shown = self.letters[32] + unit[1:] if unit[0] == " " else unit
        else:
            shown = unit.encode("utf-8").decode("latin-1").translate(self.letters)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(shown)])

    def _spaced(self, word: str) -> bytes:
        """Ids of a word that makes one unit with the space before it."""
        data = self.tails.get(word) or self.old.get(word) or self._unit(" " + word)
        if len(word) <= CACHED:
            self.tails[word] = data
        return data

    def _bare(self, unit: str) -> bytes:
        """Ids of a unit without a space before it."""
        data = self.units.get(unit)
        if data is None:
            data = self._unit(unit)
            if len(unit) <= CACHED:
                if len(self.units) > self.limit // 8:
                    self.units.clear()
                self.units[unit] = data
        return data

    def _word(self, word: str) -> bytes:
        """Ids of a word with a space before it."""
        plain = _PLAIN.fullmatch(word) if self.plain else None
        if plain:
            letters, marks, line, end = plain.groups()
            if letters == word:
                return self._unit(" " + word)
            data = self._spaced(letters)
            if marks:
                data += self._bare(marks)
            if line:
                data += self._bare("\n") + self._bare(line)
                if end:
                    data += self._bare(end)
            return data
        if not _COMMON.fullmatch(word) or self.added is not None and self.added.search(word):
            return self.whole([" " + word])[0]
        first, *rest = self.units_of(" " + word)
        return self._spaced(first[1:]) + b"".join(map(self._bare, rest))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text."""
        if not self.cuts:
            return self.whole([t or "" for t in texts])
        out: list[bytes] = []
        for text in texts:
            if len(self.tails) > self.limit:
                self.old, self.tails = self.tails, {}
            if len(self.heads) > self.limit // 8:
                self.heads = {}
            out.append(self._text(text) if text else b"")
        return out

    def _text(self, text: str) -> bytes:
        words = text.split(" ")
        tails = self.tails
        found = list(map(tails.get, words))
        head = self.heads.get(words[0])
        if head is None:
            if words[0][-1:].isspace():
                return self._with_care(text)
            head = self.whole([words[0]])[0]
            if len(words[0]) <= CACHED:
                self.heads[words[0]] = head
        found[0] = head
        old = self.old
        for at in [i for i, data in enumerate(found) if data is None]:
            word = words[at]
            data = tails.get(word) or old.get(word)
            if data is None:
                if not word or word[0].isspace() or word[-1].isspace():
                    return self._with_care(text)
                data = self._word(word)
            if len(word) <= CACHED:
                tails[word] = data
            found[at] = data
        return b"".join(found)

    def _with_care(self, text: str) -> bytes:
        return b"".join(self.whole(_CUT.split(text)))


def coder(path: str) -> ByteTokens:
    """One coder for each Python worker: its vocabulary and caches outlive a task."""
    return workercache.keep(("bytes", path), lambda: ByteTokens(path))
