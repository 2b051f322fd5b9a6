"""Speaker realignment and utterances over words, and the protocols of signal backends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from sheaf.runtime import ship

_MARKS = frozenset(".?!")


def sentence_spans(words: list[str]) -> list[tuple[int, int]]:
    """For each word the first and last word of its sentence; one ends at a word whose last
    character is a full stop, question or exclamation mark, and with the last word."""
    spans: list[tuple[int, int]] = []
    first = 0
    for k, word in enumerate(words):
        if word[-1:] in _MARKS and word or k == len(words) - 1:
            spans += [(first, k)] * (k - first + 1)
            first = k + 1
    return spans


def realign(words: list[str], speakers: list[str], longest: int = 50) -> list[str]:
    """Where the speaker changes inside a sentence for the first time, the sentence's majority
    speaker takes all of it, if the sentence has at most ``longest`` words and the majority at
    least half of them, rounded down; of equals the one who speaks first."""
    out = list(speakers)
    spans = sentence_spans(words)
    k = 0
    while k < len(words) - 1:
        first, last = spans[k]
        changes = k < last and out[k] != out[k + 1]
        if changes and last - first < longest and all(s == out[k] for s in out[first:k]):
            said = out[first : last + 1]
            most = max(dict.fromkeys(said), key=said.count)
            if said.count(most) >= len(said) // 2:
                out[first : last + 1] = [most] * len(said)
                k = last
        k += 1
    return out


def ends_sentence(word: str, following: str) -> bool:
    """Whether a sentence ends between two words: after a question or exclamation mark, or a
    full stop that is neither an ellipsis nor an initial before a name."""
    if word[-1:] in ("?", "!"):
        return True
    if not word.endswith(".") or word.endswith(".."):
        return False
    return not (len(word) == 2 and word[0].isalpha() and following[:1].isupper())


Utterance = tuple[str, float, float, str]


def utterances(words: list[str], speakers: list[str], starts: list[float], ends: list[float], first_turn: tuple[str, float, float] | None = None) -> list[Utterance]:
    """(speaker, start, end, text): a new one on a change of speaker or after a sentence; every
    word is followed by a space.

    ``first_turn``, a speaker with start and end, opens the first utterance: it keeps the
    turn's start, and stays empty if another speaker has the first word."""
    out: list[Utterance] = [(*first_turn, "")] if first_turn else []
    before = ""
    for k, (word, who, a, b) in enumerate(zip(words, speakers, starts, ends)):
        if out and out[-1][0] == who and not (before and ends_sentence(before, word)):
            out[-1] = (who, out[-1][1], b, out[-1][3] + word + " ")
        else:
            out.append((who, a, b, word + " "))
        before = word
    return out


def realigned_words(words: DataFrame, item: str, order: str) -> DataFrame:
    """``words`` (item, order, word, speaker and others) with the realigned speakers."""
    ship(words.sparkSession)

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(order)
        f["speaker"] = realign(list(f["word"]), list(f["speaker"]))
        return f

    return words.groupBy(item).applyInPandas(work, words.schema)


def speaker_utterances(words: DataFrame, item: str, order: str, turns: DataFrame | None = None) -> DataFrame:
    """``words``: item, order, word, speaker, start, end; ``turns``: item, speaker, start, end.
    One row per utterance of an item; an item is one recording, whose words fit a task. With
    turns, each item's earliest opens its first utterance."""
    ship(words.sparkSession)
    kind = dict(words.dtypes)[item]
    schema = f"{item} {kind}, utterance bigint, speaker string, start double, end double, text string"

    def found(f: pd.DataFrame, first_turn: tuple | None) -> pd.DataFrame:
        f = f.sort_values(order)
        given = list(f["word"])
        rows = utterances(given, realign(given, list(f["speaker"])), list(f["start"]), list(f["end"]), first_turn)
        out = pd.DataFrame(rows, columns=["speaker", "start", "end", "text"])
        out.insert(0, "utterance", range(1, len(out) + 1))
        out.insert(0, item, f[item].iloc[0])
        return out

    if turns is None:
        return words.groupBy(item).applyInPandas(lambda frame: found(frame, None), schema)

    def both(frame: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        first = own.sort_values(["start", "end"]).iloc[0] if len(own) else None
        return found(frame, None if first is None else (first["speaker"], float(first["start"]), float(first["end"])))

    return words.groupBy(item).cogroup(turns.groupBy(item)).applyInPandas(both, schema)


#: A signal backend maps batches of (path, content) to batches of its own schema.
Backend = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
_backends: dict[str, tuple[Backend, str]] = {}


def register_backend(name: str, run: Backend, schema: str) -> None:
    """Offer a backend for transcription, diarization, conversion, pitch or embeddings."""
    _backends[name] = (run, schema)


def run_backend(name: str, files: DataFrame) -> DataFrame:
    if name not in _backends:
        raise RuntimeError(f"no backend {name!r} is registered; there are {sorted(_backends)}")
    run, schema = _backends[name]
    return files.select("path", "content").mapInPandas(run, schema)
