"""SimHash fingerprints linked through a byte-position inverted index.

A fingerprint is eight bytes. Two that differ in at most four bits differ in at most four
bytes, so they share at least four positional bytes: that is the guaranteed minimum of
matches, and the count filter.

The index has a posting list for each byte position and byte. Tallying over whole lists
would touch a share of all pairs, so lists are dealt out first: by the bytes at each of
several sets of positions, chosen so that any four of the eight positions hold one set.
Pairs that reach the minimum therefore meet in some task. The sets are pairs of positions,
or triples, or fours, whichever keeps what meets small for the number of fingerprints
(:func:`position_sets`); each choice finds the same pairs. Where they meet, posting lists
of all eight positions are built over the members, each member's positional bytes are
looked up in them and its matches are tallied; pairs with fewer than the minimum are dropped
and the rest are verified by their differing bits.

Only distinct fingerprints are indexed, and a task never gives out its pairs: it gives a
spanning forest of its links, which has fewer edges than members and the same components.
More than ``block`` members are cut into blocks and worked on by pairs of blocks.

Defined cases: a null or blank text has fingerprint zero and links like any other; a null
document id has a fingerprint, and its component is the smallest non-null id reachable,
or null; repeated rows each come back; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm import workercache
from sheaf.llm.components import components
from sheaf.runtime import materialize, quoted, ship, small

_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def position_sets(size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` positions of which any four positions hold one. Pairs: those within
    three groups of positions. Triples: those within a group, and two of a group with one of
    the next. Fours: all."""
    if size == 4:
        return list(combinations(range(8), 4))
    found = [c for g in _GROUPS for c in combinations(g, size)]
    if size == 3:
        found += [(*c, d) for g, h in zip(_GROUPS, (*_GROUPS[1:], _GROUPS[0])) for c in combinations(g, 2) for d in h]
    return found


def set_size(fingerprints: int) -> int:
    """Positions in a set, so that some 256 different fingerprints meet on average."""
    return 2 if fingerprints <= 1 << 24 else 3 if fingerprints <= 1 << 32 else 4


def shingle_hashes(text: bytes, words: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``words`` words; of the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest

    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxh64_intdigest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[words - 1 :].tolist()
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops)], dtype=np.uint64)


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """A bit is set if it is set in more than half of the shingles' hashes."""
    hashes = shingle_hashes((text or "").encode("utf-8", "surrogatepass"), words, seed)
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        bits = np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, fp and the columns ``keep``: the fingerprint as a signed long with the same bits."""
    ship(docs.sparkSession)
    keep = keep or {}
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"), *[c.alias(n) for n, c in keep.items()])
    kept = list(keep)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType()), *rows.schema.fields[2:]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workercache.clear()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [_signed(fingerprint(t, words)) for t in part.column(1).to_pylist()]
                more = [part.column(2 + c) for c in range(len(kept))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int64()), *more], names=["doc_id", "fp", *kept])

    return rows.mapInArrow(scan, schema)


def matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The tally of pairs: how many of the eight positional bytes they share."""
    return (a.view(np.uint8).reshape(-1, 8) == b.view(np.uint8).reshape(-1, 8)).sum(axis=1)


class PostingLists:
    """An inverted index of fingerprints by byte position and byte, which members leave."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.left, self.next = np.ascontiguousarray(fps), len(fps), 0
        self.there = np.ones(len(fps), dtype=bool)
        own = self.fps.view(np.uint8).reshape(-1, 8)
        self.members = [np.argsort(own[:, p], kind="stable") for p in range(8)]
        self.starts = [np.concatenate(([0], np.cumsum(np.bincount(own[:, p], minlength=256)))) for p in range(8)]

    def tally(self, fp: int) -> np.ndarray:
        """For each member in how many of the fingerprint's eight posting lists it is."""
        count = np.zeros(len(self.fps), dtype=np.uint8)
        for p in range(8):
            byte = fp >> 8 * p & 255
            count[self.members[p][self.starts[p][byte] : self.starts[p][byte + 1]]] += 1
        return count

    def take(self, fp: int, bits: int, least: int) -> list[int]:
        """The members linked to the fingerprint; they leave."""
        if not self.left:
            return []
        if 2 * self.left < len(self.fps):
            self.__init__(self.fps[self.there])
        reach = np.flatnonzero((self.tally(fp) >= least) & self.there)
        hit = reach[np.bitwise_count(self.fps[reach] ^ np.uint64(fp)) <= bits]
        self.there[hit] = False
        self.left -= len(hit)
        return self.fps[hit].tolist()

    def pop(self) -> int:
        """Some member; it leaves."""
        while not self.there[self.next]:
            self.next += 1
        self.there[self.next] = False
        self.left -= 1
        return int(self.fps[self.next])


def forest(members: np.ndarray, others: np.ndarray | None, bits: int, least: int) -> list[tuple[int, int]]:
    """Spanning edges of the links among ``members``, or between them and ``others``.

    A search that takes each fingerprint out of the index when it is reached; so no more
    edges come out than members, and a clique costs few looks at the index.
    """
    one = PostingLists(members)
    sides = [one, one if others is None else PostingLists(others)]
    edges: list[tuple[int, int]] = []
    while one.left:
        queue = [(0, one.pop())]
        while queue:
            side, x = queue.pop()
            found = sides[1 - side].take(x, bits, least)
            edges += [(x, y) for y in found]
            queue += [(1 - side, y) for y in found]
    return edges


def _edges(rows: np.ndarray, bits: int, least: int, small: int = 16) -> pa.RecordBatch:
    """Edges of whole groups. ``rows``: list, the two blocks that meet, own block and
    fingerprint, sorted by the first three, which name the group.

    Groups of at most ``small`` members are compared all at once, by shifts; larger ones
    by posting lists of their own.
    """
    i, j, own, fps = rows[:, 1], rows[:, 2], rows[:, 3], rows[:, 4].copy().view(np.uint64)
    opens = np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1))) if len(rows) else np.zeros(0, dtype=bool)
    group, start = np.cumsum(opens), np.flatnonzero(opens)
    size = np.diff(np.append(start, len(rows)))
    few = np.repeat(size <= small, size) & (i == j)
    ends: list[np.ndarray] = []
    for d in range(1, small):
        near = np.flatnonzero(few[d:] & (group[d:] == group[:-d]))
        x, y = fps[near], fps[near + d]
        hit = np.flatnonzero(matches(x, y) >= least)
        hit = hit[np.bitwise_count(x[hit] ^ y[hit]) <= bits]
        ends.append(np.stack((x[hit], y[hit]), axis=1))
    for at in np.flatnonzero((size > 1) & ~few[start]):
        a, b = start[at], start[at] + size[at]
        part, side = fps[a:b], own[a:b] == i[a]
        found = forest(part, None, bits, least) if i[a] == j[a] else forest(part[side], part[~side], bits, least)
        ends.append(np.array(found, dtype=np.uint64).reshape(-1, 2))
    both = np.concatenate(ends).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def links(distinct: DataFrame, bits: int = 4, block: int = 4096, positions: int | None = None, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(a, b): a spanning forest of the links between distinct fingerprints ``fp``.

    What meets is counted first, combined before the shuffle. A short list meets in one
    task; a long one is dealt into blocks by a hash of the fingerprint, and every pair of
    blocks is a group of its own. ``positions`` sets the positions in a set, otherwise
    their number follows the number of fingerprints.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the index guarantees a meeting for at most four differing bits")
    least = 8 - bits
    ship(distinct.sparkSession)
    sets = position_sets(positions or set_size(distinct.count()))
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    lists = [reduce(lambda x, p: x * 256 + byte(p), places, F.lit(k).cast("long")) for k, places in enumerate(sets)]
    index = distinct.select("fp", F.explode(F.array(*lists)).alias("list"))
    long_lists = materialize(index.groupBy("list").count().where(F.col("count") > block), "lists")
    blocks = long_lists.select("list", F.ceil(F.col("count") * 2 / F.lit(block)).cast("int").alias("m"))
    dealt = index.join(small(blocks, 16, broadcast_bytes), "list", "left").withColumn("m", F.coalesce("m", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    pairs = dealt.select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workercache.clear()
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(5)], axis=1)
            cut = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
            if not len(cut) and held and (held[0][0, :3] == rows[-1, :3]).all():
                held.append(rows)
                continue
            done = int(cut[-1]) + 1 if len(cut) else 0
            yield _edges(np.concatenate([*held, rows[:done]]), bits, least)
            held = [rows[done:]]
        if held:
            yield _edges(np.concatenate(held), bits, least)

    return pairs.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j").mapInArrow(search, "a long, b long")


def grouped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4, block: int = 4096,
            keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, fp, root, component_id, and the columns ``keep``: one row per row of ``docs``.
    ``root`` is a fingerprint that names the component, also where no row of it has an id."""
    rows = materialize(fingerprints(docs, id_col, text_col, words, keep), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    joined = components(links(classes.select("fp"), bits, block))
    # the component of a fingerprint is named by one of its fingerprints; its documents' least id follows
    of = classes.join(joined.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = of.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows.join(of.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4, block: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``."""
    found = grouped(docs, id_col=id_col, text_col=text_col, words=words, bits=bits, block=block)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 32 << 20, **how) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which one of each component stays:
    that of the smallest id, then of the smallest hash of its text, then of the first of all
    its columns in order. Rows without an id come after all others."""
    names = [F.col(quoted(n)) for n in docs.columns]
    ident, th = F.col(quoted(id_col)).cast("long"), F.xxhash64(F.col(quoted(text_col)))
    found = grouped(docs, id_col=id_col, text_col=text_col, keep={"th": th}, **how)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), "th"))
    kept = found.groupBy("root").agg(first.alias("k")).select(F.col("k.id").alias("doc_id"), F.col("k.th").alias("th"))
    rows = materialize(found.groupBy("doc_id", "th").count(), "rows")
    # few rows go, and fewer are equal in id and text: only these are looked up
    gone = rows.alias("r").join(kept.alias("k"), F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.th") == F.col("k.th")), "left_anti")
    gone, twice = (materialize(x.select(F.col("doc_id").alias("__sheaf_id"), F.col("th").alias("__sheaf_th")), "rows") for x in (gone, rows.where("count > 1")))
    same = ident.eqNullSafe(F.col("__sheaf_id")) & (th == F.col("__sheaf_th"))
    left = docs.join(small(gone, 64, broadcast_bytes), same, "left_anti")
    if twice.isEmpty():
        return left.select(*names)
    twice = small(twice, 64, broadcast_bytes)
    whole = F.struct(*names)
    least = F.min_by(whole, F.to_json(whole)) if "map<" in docs.schema.simpleString() else F.min(whole)  # maps have no order
    one = left.join(twice, same, "left_semi").groupBy(ident, th).agg(least.alias("__sheaf_row"))
    return left.join(twice, same, "left_anti").select(*names).unionByName(one.select(*[F.col("__sheaf_row").getField(n).alias(n) for n in docs.columns]))
