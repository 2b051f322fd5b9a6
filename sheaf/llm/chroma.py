"""Chroma fingerprints of audio columns, and alignment of recordings by them.

Sound is folded into twelve pitch classes per frame. Sixteen filters look at rectangles of
that image through its integral image; each gives two bits, so every frame position gives
one packed 32-bit integer. Two integers APART places from each other are 64 bits, of which
each of several fixed, partially overlapping choices of bits makes a key. Recordings
vote by each key they share for the offset between its two places; at the offset with most
votes the differing bits over the overlap decide. A cut off the frame grid or noise changes
some bits of nearly every integer, so all 64 bits seldom agree, but some choice does;
choices of both integers meet by chance less often than single integers do. The choices are
the same for tables of every size, so what else a table holds does not decide whether two
recordings meet; chance meetings grow with the square of the table, at LINK_BITS slowly.

Recordings that align without an offset, copies of one cut, form a class, so a group of
thousands of them costs no pairs. In a round of :func:`same_cuts` all that share a key at a
place meet the first of them only, each is compared with those that it meets, and what
these comparisons connect becomes one class; the next round does the same with classes.
Classes that are left are aligned at any offset; those that align without one become one
class too, links are the other pairs. All members' keys vote there, but a key at a place
once for a class, and of two classes the members with most votes for each other are
compared. What is verified are pairs with at least ``least_votes`` votes at one offset.

Silence says nothing about an alignment, so places in silence do not vote, and of a held
sound, a run of equal places, only the first and the last do.

Defined cases: null media, media that cannot be decoded and sounds shorter than one
fingerprint have no items: they are in no class and have no links; a recording silent
throughout is in a class with others of its length only; a null id keeps its row, and a
class of null ids only has a null class id and no links; repeated rows come back
each; an empty table gives no rows; other columns are ignored; sounds of any length are
read whole.
"""

from __future__ import annotations

import hashlib
import io
import math
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.components import components
from sheaf.runtime import materialize, quoted, ship

RATE, FRAME, HOP = 11025, 4096, 1365
LOW_HZ, HIGH_HZ = 28.0, 3520.0
WIDTH = 16
#: Distance of the two integers that vote together, half a filter image; less if a shorter
#: overlap is asked for.
APART = 8
#: Choices of bits and bits in each, for copies of one cut and for links.
KEYS, KEY_BITS = 16, 40
LINK_KEYS, LINK_BITS = 28, 45
#: Bounds of :func:`extra_bits`.
KEY_PLACES, MOST_BITS = 1 << 19, 54
#: Members of a group whose places come together before they are dealt out by keys.
GROUP_BLOCK = 1024
#: Keys that one task joins.
TASK_KEYS = 250_000
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25], dtype=np.float32)
#: Thresholds between the four levels of a filter's log ratio; the middle one is not 0, which
#: a held sound gives in all filters of equal halves, and rounding would decide.
LEVELS = np.array([-0.25, 0.02, 0.25], dtype=np.float32)


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames) by rule: kinds in turn, the
    rectangles spread over the twelve classes and growing from 4 to 16 frames."""
    return [(k % 6, (5 * k) % 7, 3 + k % 4, 4 + 4 * (k % 4)) for k in range(16)]


FILTERS = _filters()


def key_masks(keys: int = KEYS, bits: int = KEY_BITS) -> list[int]:
    """The choices of bits as signed 64-bit masks: for each, the first bits by a digest."""
    masks = []
    for k in range(keys):
        mask = sum(1 << b for b in sorted(range(64), key=lambda b: hashlib.md5(f"{k} {b}".encode()).digest())[:bits])
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def extra_bits(places: int) -> int:
    """Bits by which keys would be longer, and choices by which they would be more, for chance
    meetings to grow as the table does: three for each doubling of the places over KEY_PLACES.
    For a caller who passes them to :func:`align`; links then depend on the table's size.
    """
    return min(MOST_BITS - KEY_BITS, math.ceil(3 * math.log2(places / KEY_PLACES))) if places > KEY_PLACES else 0


Decoder = Callable[[object], "tuple[int, np.ndarray] | None"]


def decode_wav(data: object) -> tuple[int, np.ndarray] | None:
    """(rate, mono samples in -1..1) of PCM WAV bytes; None if they are not that."""
    if data is None:
        return None
    try:
        with wave.open(io.BytesIO(bytes(data))) as w:
            rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
            raw = w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return None
    if width == 1:
        samples = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width in (2, 4):
        samples = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    else:
        return None
    return rate, samples[: len(samples) // channels * channels].reshape(-1, channels).mean(axis=1)


def _pitch_classes() -> np.ndarray:
    hz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    fold = np.zeros((len(hz), 12), dtype=np.float32)
    use = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    note = np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % 12
    fold[use, note] = 1
    return fold


_FOLD = _pitch_classes()
_TAPER = np.hamming(FRAME).astype(np.float32)


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames of twelve smoothed pitch-class energies, each frame of length one."""
    x = np.asarray(samples, dtype=np.float32)
    if rate != RATE and len(x):
        at = np.arange(int(len(x) * RATE / rate)) * (rate / RATE)
        x = np.interp(at, np.arange(len(x)), x).astype(np.float32)
    if len(x) < FRAME:
        return np.zeros((0, 12), dtype=np.float32)
    out = []
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for at in range(0, len(frames), 256):
        spectrum = np.fft.rfft(frames[at : at + 256] * _TAPER, axis=1)
        out.append((spectrum.real**2 + spectrum.imag**2) @ _FOLD)
    image = np.concatenate(out)
    if len(image) < len(SMOOTH):
        return np.zeros((0, 12), dtype=np.float32)
    image = sum(c * image[k : len(image) - len(SMOOTH) + 1 + k] for k, c in enumerate(SMOOTH))
    size = np.sqrt((image**2).sum(axis=1, keepdims=True))
    return np.where(size > 1e-3, image / np.maximum(size, 1e-9), 0).astype(np.float32)


def items(image: np.ndarray) -> np.ndarray:
    """Packed integers, one for each run of WIDTH frames."""
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    t = np.arange(n)

    def area(t0, t1, p0, p1):
        return total[t + t1, p1] - total[t + t0, p1] - total[t + t1, p0] + total[t + t0, p0]

    packed = np.zeros(n, dtype=np.uint32)
    for kind, p, h, w in FILTERS:
        h2, w2, h3, w3 = h // 2, w // 2, h // 3, w // 4
        whole = area(0, w, p, p + h)
        if kind == 0:
            a = np.full(n, w * h / 12.0) * 0.5
            b = whole
        elif kind == 1:
            a = area(0, w, p + h2, p + h)
            b = whole - a
        elif kind == 2:
            a = area(w2, w, p, p + h)
            b = whole - a
        elif kind == 3:
            a = area(0, w2, p + h2, p + h) + area(w2, w, p, p + h2)
            b = whole - a
        elif kind == 4:
            a = area(0, w, p + h3, p + h - h3)
            b = whole - a
        else:
            a = area(w3, w - w3, p, p + h)
            b = whole - a
        level = np.searchsorted(LEVELS, np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0))).astype(np.uint32)
        packed = (packed << np.uint32(2)) | (level ^ (level >> np.uint32(1)))  # neighbours differ in one bit
    return packed


def fingerprint(media: object, decode: Decoder = decode_wav) -> np.ndarray:
    sound = decode(media)
    return items(chroma(sound[1], sound[0])) if sound is not None else np.zeros(0, dtype=np.uint32)


def fingerprints(rows: DataFrame, *, id_col: str, media_col: str, decode: Decoder = decode_wav) -> DataFrame:
    """id, items (little-endian unsigned 32-bit integers as bytes)."""
    ship(rows.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [fingerprint(m.as_py(), decode).astype("<u4").tobytes() for m in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["id", "items"])

    chosen = rows.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(media_col)).alias("media"))
    return chosen.mapInArrow(scan, "id long, items binary")


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """(share of differing bits, overlap) with place t + offset of ``a`` on place t of ``b``."""
    start, stop = max(0, -offset), min(len(b), len(a) - offset)
    n = stop - start
    if n <= 0:
        return 1.0, 0
    return float(np.bitwise_count(a[start + offset : stop + offset] ^ b[start:stop]).sum()) / (32 * n), n


SILENT = int(items(np.zeros((WIDTH, 12), dtype=np.float32))[0])


def voting_places(x: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, pairs of integers ``apart`` places from each other as 64 bits) of those that
    vote: not in silence, and the ends of runs of one value only."""
    x = x.astype(np.uint64)
    both = x[:-apart] << np.uint64(32) | x[apart:]
    if not len(both):
        return np.zeros(0, dtype=np.int64), both
    ends = np.ones(len(both), dtype=bool)
    ends[1:-1] = (both[1:-1] != both[:-2]) | (both[1:-1] != both[2:])
    at = np.flatnonzero(ends & (both != np.uint64(SILENT << 32 | SILENT)))
    return at, both[at]


def _places(classes: DataFrame, apart: int, every: int = 1, turn: int = 0) -> DataFrame:
    """(value, g, c, t) of the places that vote, or of each ``every``-th from ``turn`` on. Of
    members of a group that come together, a value at a place is the smallest member's."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for g, c, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                t, x = voting_places(np.frombuffer(data, "<u4"), apart)
                keep = t % every == turn
                one = np.empty((int(keep.sum()), 4), dtype=np.int64)
                one[:, 0], one[:, 1], one[:, 2], one[:, 3] = g, t[keep], x[keep].view(np.int64), c
                found.append(one)
            if found:
                rows = np.concatenate(found)
                rows = rows[np.lexsort(rows.T[::-1])]
                again = np.zeros(len(rows), dtype=bool)
                again[1:] = (rows[1:, :3] == rows[:-1, :3]).all(axis=1)
                g, t, x, c = rows[~again].T.copy()
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(g), pa.array(c), pa.array(t.astype(np.int32))], names=["value", "g", "c", "t"])

    return classes.select("group_id", "class_id", "items").mapInArrow(places, "value long, g long, c long, t int")


def _keys(masks: list[int], *more: Column) -> Column:
    return F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("value").bitwiseAND(F.lit(m)), *more) for k, m in enumerate(masks)])).alias("key")


def _verified(pairs: DataFrame, classes: DataFrame, most_error: float, least_overlap: int) -> DataFrame:
    """The pairs ``a, b, offset`` (and others) of classes whose bits agree, with error and overlap."""
    others = [c for c in pairs.columns if c not in ("a", "b", "offset")]
    x = classes.select(F.col("class_id").alias("a"), F.col("items").alias("x"))
    y = classes.select(F.col("class_id").alias("b"), F.col("items").alias("y"))
    met = pairs.join(x, "a").join(y, "b").select("a", "b", "offset", "x", "y", *others)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shift, p, q = (batch.column(k).to_pylist() for k in (2, 3, 4))
            found = [bit_error(np.frombuffer(u, "<u4"), np.frombuffer(v, "<u4"), o) for u, v, o in zip(p, q, shift)]
            made = [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int32())]
            kept = [batch.column(k) for k in (0, 1, 2)] + [batch.column(5 + k) for k in range(len(others))]
            yield pa.RecordBatch.from_arrays(kept + made, names=["a", "b", "offset", *others, "error", "overlap"])

    schema = ", ".join(f"{c} {t}" for c, t in pairs.select("a", "b", "offset", *others).dtypes)
    checked = met.mapInArrow(verify, f"{schema}, error double, overlap int")
    return checked.where((F.col("error") <= most_error) & (F.col("overlap") >= least_overlap))


def _apart(least_overlap: int) -> int:
    return max(1, min(APART, least_overlap // 2))


def _grouped_places(grouped: DataFrame, apart: int, every: int = 1, turn: int = 0) -> DataFrame:
    """(value, g, c, t, many) of classes ``class_id, items, group_id``: each value at a place once
    for a group, ``many`` if the group has several members. Members come together in blocks, so that most of what they share is left out
    before it is dealt by value."""
    several = grouped.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(grouped.join(several, "group_id"), "members")
    alone = _places(grouped.join(members, "class_id", "left_anti"), apart, every, turn)
    block = F.pmod(F.xxhash64("class_id"), F.ceil(F.col("n") / GROUP_BLOCK))
    near = members.repartition("group_id", block).sortWithinPartitions("group_id", block)
    shared = _places(near, apart, every, turn).groupBy("value", "g", "t").agg(F.min("c").alias("c")).select("value", "g", "c", "t")
    return materialize(alone.withColumn("many", F.lit(False)).unionByName(shared.withColumn("many", F.lit(True))), "places")


def same_cuts(classes: DataFrame, *, most_error: float, least_votes: int, least_overlap: int, every: int = 8, rounds: int = 2) -> DataFrame:
    """class_id, items and group_id of the fingerprints ``class_id, items``: those that align
    without an offset, named by the smallest of them; one without any is its own group.

    A round looks at every ``every``-th place, by half of the choices of bits, and at others
    than the round before. The first of a list is found by an aggregate, so a list of any
    length gives no more rows than it has groups.
    """
    ship(classes.sparkSession)
    grouped = classes.select("class_id", "items", F.col("class_id").alias("group_id"))
    for turn in range(rounds):
        placed = _grouped_places(grouped, _apart(least_overlap), every, turn * every // rounds)
        half = key_masks()[turn % 2 * KEYS // 2 :][: KEYS // 2]
        keyed = placed.select(_keys(half, F.col("t")), "g", "c")
        first = keyed.groupBy("key").agg(F.min("g").alias("a"), F.min_by("c", "g").alias("ac"), F.count("*").alias("n")).where("n > 1").drop("n")
        met = keyed.join(first, "key").where("g <> a").groupBy("g", "a", "c", "ac").agg(F.count("*").alias("n"))
        best = met.groupBy("g", "a").agg(F.sum("n").alias("count"), F.max(F.struct("n", (-F.col("c")).alias("c"), (-F.col("ac")).alias("ac"))).alias("best"))
        pairs = best.where(F.col("count") >= least_votes).select("g", F.col("a").alias("first"), (-F.col("best.ac")).alias("a"),
                                                                 (-F.col("best.c")).alias("b"), F.lit(0).alias("offset"))
        edges = _verified(pairs, classes, most_error, least_overlap)
        joined = components(edges.select(F.col("first").alias("a"), F.col("g").alias("b")))
        named = grouped.join(joined, F.col("group_id") == F.col("node"), "left")
        grouped = materialize(named.select("class_id", "items", F.coalesce("root", "group_id").alias("group_id")), "groups")
    return grouped


def _link_keys(placed: DataFrame, masks: list[int]) -> DataFrame:
    """(key, g, t, m) of places: a key at a place once for a class, however many of its values
    have it, so two classes of many members meet no more often than two of one. The smallest
    such member is ``g`` xor ``m``, and m is 0 for most rows, which packs well."""
    m = F.col("c").bitwiseXOR(F.col("g")).alias("m")
    once = placed.where("many").select(_keys(masks), "g", "c", "t").groupBy("key", "g", "t").agg(F.min("c").alias("c"))
    return placed.where("not many").select(_keys(masks), "g", "t", m).unionByName(once.select("key", "g", "t", m))


def align(classes: DataFrame, *, most_error: float, least_votes: int, least_overlap: int, extra: int | None = None) -> DataFrame:
    """(a, b, offset, error, overlap) for the groups that align, a < b.

    ``classes``: class_id, items, and group_id if near copies have been grouped. Of several
    offsets with most votes the smallest in size decides, then the smaller; what is compared
    are the members with most votes for each other there, the smallest of several. ``extra``
    asks for KEYS and KEY_BITS with so many more of each.
    """
    ship(classes.sparkSession)
    apart = _apart(least_overlap)
    if "group_id" in classes.columns:
        placed = _grouped_places(classes, apart)
    else:
        placed = materialize(_places(classes.withColumn("group_id", F.col("class_id")), apart).withColumn("many", F.lit(False)), "places")
    count = placed.count()
    masks = key_masks(LINK_KEYS, LINK_BITS) if extra is None else key_masks(KEYS + extra, KEY_BITS + extra)
    keyed = _link_keys(placed, masks)
    # dealt once for both sides, in parts that are sorted in memory
    keyed = keyed.repartition(max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), count * len(masks) // TASK_KEYS), "key")
    left = keyed.select("key", F.col("g").alias("a"), F.col("m").alias("ma"), F.col("t").alias("ta"))
    right = keyed.select("key", F.col("g").alias("b"), F.col("m").alias("mb"), F.col("t").alias("tb"))
    votes = left.join(right, "key").where("a < b").groupBy("a", "b", (F.col("ta") - F.col("tb")).alias("offset"), "ma", "mb").agg(F.count("*").alias("n"))
    members = F.struct("n", (-F.col("a").bitwiseXOR(F.col("ma"))).alias("ca"), (-F.col("b").bitwiseXOR(F.col("mb"))).alias("cb"))
    votes = votes.groupBy("a", "b", "offset").agg(F.sum("n").alias("count"), F.max(members).alias("m")).where(F.col("count") >= least_votes)
    best = votes.groupBy("a", "b").agg(F.max(F.struct("count", (-F.abs("offset")).alias("near"), (-F.col("offset")).alias("o"), "m")).alias("best"))
    pairs = best.select(F.col("a").alias("ga"), F.col("b").alias("gb"), (-F.col("best.o")).cast("int").alias("offset"),
                        (-F.col("best.m.ca")).alias("a"), (-F.col("best.m.cb")).alias("b"))
    checked = _verified(pairs, classes, most_error, least_overlap)
    return checked.select(F.col("ga").alias("a"), F.col("gb").alias("b"), "offset", "error", "overlap")


def recordings(rows: DataFrame, *, id_col: str, media_col: str, decode: Decoder = decode_wav, most_error: float = 0.15,
               least_votes: int = 2, least_overlap: int = 20) -> DataFrame:
    """id, n_items, items_crc32, class_id, n_links: each recording, the smallest id among those
    of its class, and how many other classes align with its own."""
    found = materialize(fingerprints(rows, id_col=id_col, media_col=media_col, decode=decode), "fingerprints")
    sound = found.where(F.length("items") > 0)
    distinct = materialize(sound.groupBy("items").agg(F.min("id").alias("class_id")).select("class_id", "items"), "classes")
    grouped = same_cuts(distinct.where("class_id is not null"), most_error=most_error, least_votes=least_votes, least_overlap=least_overlap)
    linked = materialize(align(grouped, most_error=most_error, least_votes=least_votes, least_overlap=least_overlap), "links")
    root = components(linked.where("offset = 0")).withColumnRenamed("root", "whole")
    far = linked.where("offset <> 0").select("a", "b")
    for end in ("a", "b"):
        far = far.join(root.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("whole", end)).drop("whole")
    far = far.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = far.select(F.col("a").alias("whole")).union(far.select("b")).groupBy("whole").agg(F.count("*").alias("n"))
    whole = grouped.join(root, F.col("group_id") == F.col("node"), "left").select("items", F.coalesce("whole", "group_id").alias("whole"))
    named = whole.join(ends, "whole", "left").select("items", F.col("whole").alias("class_id"), "n")
    return found.join(named, "items", "left").select(
        "id", (F.length("items") / 4).cast("long").alias("n_items"), F.crc32("items").alias("items_crc32"),
        "class_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
    )


def render(vector: object) -> tuple[int, np.ndarray] | None:
    """A melody for a vector, where a table has no recordings: each pair of components is a
    quarter-second note, the first its pitch class and the second its loudness."""
    if vector is None:
        return None
    v = np.array([np.nan if x is None else x for x in vector], dtype=np.float64)
    if not len(v) or not np.isfinite(v).all():
        return None
    v = np.append(v, 0.0) if len(v) % 2 else v
    spread = np.sqrt((v**2).mean()) or 1.0
    note = np.clip(np.floor((v[0::2] / spread / 4 + 0.5) * 12), 0, 11).astype(int)
    loud = (0.6 + 0.4 * np.tanh(v[1::2] / spread)).astype(np.float32)
    return RATE, (_NOTES[note] * loud[:, None]).ravel()


_NOTES = np.stack([np.sin(2 * np.pi * 440.0 * 2 ** (k / 12) * np.arange(RATE // 4) / RATE) for k in range(12)]).astype(np.float32)
