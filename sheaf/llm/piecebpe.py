"""SentencePiece BPE ids by the prefix table, without running any merges.

In a merge-type vocabulary every prefix of a text has one last token in its encoding. A
table over the prefixes therefore holds the whole encoding: the ids are read from the last
prefix backwards. The tokens that end at a position come from an Aho-Corasick automaton
over the vocabulary; the right one is the token whose neighbour, the last token of the
prefix before it, is compatible: the two next to each other encode to themselves. A
character that no piece holds is one unit that merges with nothing and is written as its
bytes.

No piece has the word mark after another character, so no merge crosses from a word to
the next mark. A text is cut there, and words met before come from a bounded cache; the
table is built for new words only. Where no piece mixes letters with other characters,
words are cut between these too, but marks stay with what follows. A vocabulary with
other pieces is not cut there. Words longer than ``CACHED`` characters are encoded each
time they occur, so the cache is bounded in bytes as well as in words.

Decoding reads nothing but ids: every document's text is put together from the pieces of
its own ids.

Defined cases: a null text is an empty one: its ids are the begin and end ids; repeated
rows and null document ids each come back; an empty table gives no rows; other columns
are ignored; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import workercache
from sheaf.runtime import quoted, ship

MARK = "▁"
#: Longest word, in characters, that a cache keeps.
CACHED = 64
_STRAY = re.compile("[\udc80-\udcff]+")
_WHOLE = re.compile(r"(?s).+")
_UNITS = re.compile(r"▁*[^\W\d_]+|▁*[\W\d_]")


def _letter(c: str) -> bool:
    return bool(re.match(r"[^\W\d_]", c))


class PieceCoder:
    """Encodes and decodes with the vocabulary of a SentencePiece BPE model.

    Supports what the model file states for identity normalisation with a dummy prefix and
    byte fallback; other models are refused.
    """

    def __init__(self, path: str, cache_words: int = 300_000, cache_tests: int = 1_000_000):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        special = [i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)]
        self.byte_id = {int(sp.id_to_piece(i)[3:-1], 16): i for i in special if sp.is_byte(i)}
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        probe = "  a \tÅﬁ "
        if sp.decode(sp.encode(probe)) != probe:
            raise ValueError("the model normalises texts")
        skip = set(special)
        self.ids = {sp.id_to_piece(i): i for i in range(size) if i not in skip}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.text_of = {i: p for p, i in self.ids.items()}
        # what an id stands for in a text: bytes above 127 by stand-ins until their run is known
        self.shown = [self.text_of.get(i, "").replace(MARK, " ") for i in range(size)]
        for b, i in self.byte_id.items():
            self.shown[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        self.led = {i for i, p in self.text_of.items() if p.startswith(MARK)}
        self.cuts = all(MARK not in p.lstrip(MARK) for p in self.ids)
        self.limit = cache_words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.tests, self.most_tests = 0, cache_tests
        self.tested: list[dict[str, bool]] = []
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1 and self._merged(p) == [p]:  # a piece that merges never build is no token
                made: dict[str, bool] = {}  # the tests made so far of tokens before it
                self.tested.append(made)
                self.automaton.add_word(p, (p, len(p), made))
        self.automaton.make_automaton()
        mixed = any(_letter(p[k]) != _letter(p[k + 1]) for p in self.ids for k in range(len(p) - 1) if p[k] != MARK)
        self.units = _WHOLE if mixed else _UNITS

    def _merged(self, text: str) -> list[str]:
        """The definition: merge the neighbours of best score, leftmost first, until none."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def tokens(self, text: str) -> list[str]:
        """The encoding of marked text as pieces; characters outside the vocabulary as they are."""
        n = len(text)
        if n < 2:
            return [text] if text else []
        last: list[str] = [""] * n  # the prefix table: last token of the prefix that ends here
        for at, (piece, size, fitting) in self.automaton.iter(text):  # by end, the longest first
            if last[at]:
                continue
            if size > at:
                last[at] = piece
                continue
            before = at - size
            left = last[before] or text[before]
            fits = fitting.get(left)
            if fits is None:
                fits = fitting[left] = self._merged(left + piece) == [left, piece]
                self.tests += 1
            if fits:
                last[at] = piece
        out = []
        at = n - 1
        while at >= 0:
            piece = last[at] or text[at]
            out.append(piece)
            at -= len(piece)
        out.reverse()
        return out

    def _word(self, word: str) -> bytes:
        if self.tests > self.most_tests:
            self.tests = 0
            for made in self.tested:
                made.clear()
        return b"".join([self.runs.get(u) or self._run(u) for u in self.units.findall(word)])

    def _run(self, run: str) -> bytes:
        ids: list[int] = []
        for piece in self.tokens(run):
            known = self.ids.get(piece)
            if known is None:
                ids += [self.byte_id[b] for b in piece.encode("utf-8")]
            else:
                ids.append(known)
        data = struct.pack(f"<{len(ids)}I", *ids)
        if len(run) <= CACHED:
            if len(self.runs) > self.limit:
                self.runs.clear()
            self.runs[run] = data
        return data

    def words(self, text: str) -> list[str]:
        """Cut before every mark that follows another character."""
        marked = MARK + text.replace(" ", MARK)
        if not self.cuts:
            return [marked]
        parts = marked[1:].split(MARK)
        if "" not in parts:
            return [MARK + p for p in parts]
        out, run = [], MARK
        for p in parts[:-1]:
            if p:
                out.append(run + p)
                run = MARK
            else:
                run += MARK
        out.append(run + parts[-1])
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids, with begin and end, as little-endian 32-bit integers."""
        begin, end = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        out = []
        for text in texts:
            if len(self.young) > self.limit:
                self.old, self.young = self.young, {}
            young, old = self.young, self.old
            words = self.words(text) if text else []
            found = list(map(young.get, words))
            for at in [k for k, data in enumerate(found) if data is None]:
                word = words[at]
                data = young.get(word) or old.get(word) or self._word(word)
                if len(word) <= CACHED:
                    young[word] = data
                found[at] = data
            out.append(b"".join([begin, *found, end]))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids; bytes that are no UTF-8 become U+FFFD."""
        given = [i for i in np.frombuffer(ids, "<u4").tolist() if i != self.bos and i != self.eos]
        text = "".join(map(self.shown.__getitem__, given))
        if given and given[0] in self.led:  # the dummy prefix
            text = text[1:]
        if text.isascii() or not _STRAY.search(text):
            return text
        return _STRAY.sub(lambda m: _scrub(bytes(ord(c) - 0xDC00 for c in m[0])), text)


def _scrub(data: bytes) -> str:
    """Decode byte by byte, as the library does: one replacement for every stray byte."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode("utf-8"))
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the digests of its ids and of the text that these ids decode to."""
    ship(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(model)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                found = coder.encode(texts.slice(at, 256).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, 256), pa.array([len(i) // 4 for i in found], pa.int64()),
                     pa.array([hashlib.sha256(i).hexdigest() for i in found]),
                     pa.array([hashlib.sha256(coder.decode(i).encode("utf-8")).hexdigest() for i in found])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    return rows.mapInArrow(scan, DIGEST)


def _coder(path: str) -> PieceCoder:
    """One coder for each Python worker: its tables and caches outlive a task."""
    return workercache.keep(("pieces", path), lambda: PieceCoder(path))
