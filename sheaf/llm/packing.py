"""First-fit decreasing packing of token ids in randomised groups of documents.

Documents are dealt to groups by a hash; each group is packed by itself. Inside a group
every full ``capacity`` run of a document is a sequence of its own. The remainders meet as
many bins as their ids fill: they go, longest first, each whole to the first bin with room,
which a tournament tree over the bins' remaining capacities finds in logarithmic time. A
remainder for which no bin has room is cut to fill the gaps that first-fit decreasing left,
and only these are cut. The last few ids, fewer than ``capacity``, become sequences whose
lengths are powers of two, which need no padding. With ``cut=False`` nothing but full runs
is cut: a remainder without room opens a further bin, and ``padding`` tells what that costs.

Defined cases: a null text is an empty one (its only id is the end id); null document ids
and repeated rows are packed like any others; an empty table gives no pieces; other
columns are ignored. A row's place in the table takes part in the choice of its group, so
very many rows of one id, or equal rows, are spread over all groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import bytetokens
from sheaf.runtime import quoted, ship

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """A tournament tree: every inner node holds the largest capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.best = [capacity] * (2 * self.leaves)

    def close_from(self, bins: int) -> None:
        """Leave room in the first ``bins`` leaves only."""
        best, leaves = self.best, self.leaves
        best[leaves + bins :] = [0] * (leaves - bins)
        for node in range(leaves - 1, 0, -1):
            best[node] = max(best[2 * node], best[2 * node + 1])

    def place(self, size: int) -> int:
        """Take ``size`` from the first bin with room for it and return the bin."""
        best, node, leaves = self.best, 1, self.leaves
        while node < leaves:
            node *= 2
            if best[node] < size:
                node += 1
        best[node] -= size
        found, node = node - leaves, node >> 1
        while node:
            left, right = best[2 * node], best[2 * node + 1]
            best[node] = left if left > right else right
            node >>= 1
        return found


Piece = tuple[int, int, int]  # document, start, length


def first_fit_decreasing(pieces: list[Piece], capacity: int, bins: int | None = None) -> tuple[list[list[Piece]], list[Piece]]:
    """(bins, pieces that found no room), with at most ``bins`` bins if that is given."""
    most = len(pieces) if bins is None else bins
    filled: list[list[Piece]] = [[] for _ in range(most)]
    left: list[Piece] = []
    if most:
        tree = CapacityTree(most, capacity)
        tree.close_from(most)
    for piece in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        if most and tree.best[1] >= piece[2]:
            filled[tree.place(piece[2])].append(piece)
        else:
            left.append(piece)
    return [b for b in filled if b] if bins is None else filled, left


def padding(sequences: list[list[Piece]], capacity: int) -> int:
    """Ids of padding: every sequence is filled up to ``capacity``, but not powers of two."""
    totals = [sum(p[2] for p in s) for s in sequences]
    return sum(capacity - t for t in totals if t & (t - 1))


def _take(pieces: list[Piece], most: int) -> Piece:
    """Cut up to ``most`` ids off the end of the last piece."""
    doc, start, length = pieces.pop()
    if length <= most:
        return doc, start, length
    pieces.append((doc, start, length - most))
    return doc, start + length - most, most


def fill_gaps(bins: list[list[Piece]], left: list[Piece], capacity: int) -> list[list[Piece]]:
    """The bins filled up with what found no room, and sequences of powers of two for the rest."""
    left = list(left)
    for b in bins:
        gap = capacity - sum(p[2] for p in b)
        while gap and left:
            got = _take(left, gap)
            b.append(got)
            gap -= got[2]
    rest = sum(p[2] for p in left)
    while rest:
        size = capacity if rest >= capacity else 1 << (rest.bit_length() - 1)
        rest -= size
        bins.append([])
        while size:
            got = _take(left, size)
            bins[-1].append(got)
            size -= got[2]
    return bins


def pack_group(tokens: list[int], capacity: int, cut: bool = True) -> list[list[Piece]]:
    """Sequences of pieces for documents of the given numbers of ids."""
    whole, rest = [], []
    for doc, n in enumerate(tokens):
        full = n - n % capacity
        whole += [[(doc, at, capacity)] for at in range(0, full, capacity)]
        if n > full:
            rest.append((doc, full, n - full))
    if not cut:
        return whole + first_fit_decreasing(rest, capacity)[0]
    bins, left = first_fit_decreasing(rest, capacity, sum(p[2] for p in rest) // capacity)
    return whole + fill_gaps(bins, left, capacity)


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
                   capacity: int = 1024, group_docs: int = 1024, task_groups: int = 16, seed: int = 7, cut: bool = True) -> DataFrame:
    """One row per piece. The number of groups follows the number of documents, so a group
    stays near ``group_docs`` at any scale, and tasks near ``task_groups`` groups."""
    ship(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_docs))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bytetokens.coder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        now, serial = None, 0
        names: list[int | None] = []
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal names, held, serial
            cols: list[list] = [[] for _ in range(7)]
            views = [memoryview(x) for x in held]
            for sequence in pack_group([len(x) // 4 for x in held], capacity, cut):
                offset = 0
                for doc, start, length in sequence:
                    row = (names[doc], start, length, zlib.crc32(views[doc][4 * start : 4 * (start + length)]),
                           len(held[doc]) // 4, (now << 32) + serial, offset)
                    for c, v in zip(cols, row):
                        c.append(v)
                    offset += length
                serial += 1
            names, held = [], []
            fields = [x.split()[0] for x in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=fields)

        for batch in batches:
            group, keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for at in range(0, len(keys), 512):
                coded = coder.encode(texts.slice(at, 512).to_pylist())
                for g, key, ids in zip(group[at : at + 512], keys[at : at + 512], coded):
                    if g != now:
                        if names:
                            yield close()
                        now, serial = g, 0
                    names.append(key)
                    held.append(ids + end)
        if names:
            yield close()

    place = F.monotonically_increasing_id()  # the same for a row whenever its split is read again
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("k"), F.col(quoted(text_col)).alias("t"), place.alias("place"))
    rows = rows.select(F.pmod(F.xxhash64("k", "place", F.lit(seed)), F.lit(groups)).cast("long").alias("g"), "k", "place", "t")
    tasks = groups // task_groups
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, "g") if tasks > least else rows.repartition("g")  # few groups: adaptive execution joins tasks
    return dealt.sortWithinPartitions("g", "k", "place").select("g", "k", "t").mapInArrow(pack, PIECES)
