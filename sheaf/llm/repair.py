"""Token ids as Re-Pair grammar shards with random access.

A shard is a run of whole documents in ascending id order. Its ids are one sequence in
which frequent neighbouring pairs are replaced, round after round, by nonterminals. The
shard stores the rules, how many ids every rule expands to, and the expanded position of
every 64th symbol, so any range of ids decodes without the rest.

A round counts the shard's pairs, takes all that occur at least ``least`` times as rules
and replaces their occurrences; where chosen pairs overlap the more frequent one wins, then
the left one. Rounds go on until no pair is that frequent. A pair of symbols that both
existed before a round only loses occurrences in it, so once little is replaced only the
places beside new symbols and the places of pairs still frequent are counted again.

``least`` is 8: a rule takes 12 bytes and each of its occurrences saves two to three, so
rules for rarer pairs would cost more than they save. The number of rules has no other
limit than 32-bit symbols.

Shard layout, little-endian: a header of nine unsigned 64-bit integers (magic, first
nonterminal, documents, rules, symbols, ids, bits of a symbol, sample step, null document
ids), then document ids (int64), null flags (one byte each), document ends (uint64), rules
(two uint32 each), rule expansion lengths (uint32), sampled positions (uint64), the low 16
bits of all symbols (uint16), and a plane of bits for each bit above these. A sample's 64
symbols begin at a whole byte of every plane.

Defined cases: a null text is an empty one (its only id is the end id); a null document id
sorts first and comes back as null; rows that repeat an id are separate documents, in the
order in which the table is read; an empty table gives no shards. A document never spans two
shards, so a shard holds at least one document, however long. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm import bytetokens
from sheaf.runtime import new_path, quoted, ship

MAGIC = 0x3250524552464853
STEP = 64
_HEADER = 9


def _overlapping(left: np.ndarray, right: np.ndarray, look: np.ndarray, after: np.ndarray | None) -> np.ndarray:
    """Where every other place of a run of one symbol is, whose pair overlaps the one before.
    ``after`` has the places after those looked at, if these are not the next ones."""
    twin = np.flatnonzero(left == right)
    if len(twin) < 2:
        return twin[:0]
    index = np.arange(len(twin))
    follows = look[twin[:-1]] + 1 if after is None else after[twin[:-1]]
    opens = np.concatenate(([True], follows != look[twin[1:]]))
    return twin[(index - np.maximum.accumulate(np.where(opens, index, 0))) % 2 == 1]


def _by_pair(left: np.ndarray, right: np.ndarray, place: np.ndarray, leave: np.ndarray, size: int) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray], int]:
    """Pairs in ascending order but those at ``leave``, the places of given ones of them, and
    the bits of a right symbol; a left symbol stands above these."""
    bits = size.bit_length()
    symbol = (64 - bits) // 2
    if max(int(left.max()), int(right.max())) >> symbol:
        left, right, place = (np.delete(x, leave) for x in (left, right, place))
        keys = left.astype(np.uint64) << np.uint64(32) | right
        order = np.argsort(keys, kind="stable")
        return keys[order], lambda at: place[order[at]], 32
    keys = left.astype(np.uint64)  # pair and place in one integer: a sort of values is much faster
    keys <<= np.uint64(symbol)
    keys |= right
    keys <<= np.uint64(bits)
    keys |= place.view(np.uint64)
    keys[leave] = np.iinfo(np.uint64).max
    keys.sort()
    keys = keys[: len(keys) - len(leave)]
    return keys >> np.uint64(bits), lambda at: (keys[at] & np.uint64((1 << bits) - 1)).view(np.int64), symbol


def compress(ids: np.ndarray, first: int, least: int = 8):
    """(symbols, rules as an n x 2 array, expansion length of each rule).

    While rounds replace much, they look at all places and the sequence is closed up after
    each; then places are linked to their neighbours instead, and a round costs what it looks
    at."""
    if least < 2:
        raise ValueError("a rule needs two occurrences")
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    lengths = np.ones(0, dtype=np.uint32)
    made, linked = 0, False
    free = np.iinfo(np.int32).max
    rank = np.full(len(seq) + 2, free, dtype=np.int32)  # of the pair that starts here; both ends have none
    every = np.arange(max(0, len(seq) - 1))
    look = every  # places whose pairs may be frequent
    while len(look):
        size = len(seq)
        after = nxt[look] if linked else None
        left, right = (seq[look], seq[after]) if linked else (seq[:-1], seq[1:])
        odd = _overlapping(left, right, look, after)
        run, places, symbol = _by_pair(left, right, look, odd, size)
        opens = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        counts = np.diff(np.append(opens, len(run)))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        often = often[np.argsort(-counts[often], kind="stable")]
        pairs, n = run[opens[often]], counts[often]
        hit = places(np.repeat(opens[often] - np.cumsum(n) + n, n) + np.arange(int(n.sum())))
        rank[hit] = np.repeat(np.arange(len(often), dtype=np.int32), n)
        # of pairs that overlap the more frequent one wins, then the left one
        if linked:
            own = rank[hit]
            at = hit[(own < rank[prv[hit]]) & (own <= rank[nxt[hit]])]
        else:
            here, wins = rank[:size], np.ones(size, dtype=bool)
            wins[1:] = here[1:] < here[:-1]
            wins &= here <= rank[1 : size + 1]
            wins &= here < free
            at = np.flatnonzero(wins)
        own = rank[at]
        # what too few occurrences are left for is not replaced; the most frequent pair always is
        enough = np.bincount(own, minlength=len(often)) >= least
        at, own, used = at[enough[own]], own[enough[own]], np.flatnonzero(enough)
        name = np.zeros(len(often), dtype=np.uint32)
        name[used] = np.arange(first + made, first + made + len(used), dtype=np.uint32)
        two = np.stack((pairs[used] >> np.uint64(symbol), pairs[used] & np.uint64((1 << symbol) - 1)), axis=1).astype(np.uint32)
        rules.append(two)
        lengths = np.concatenate((lengths, _length(two, first, lengths)))
        made += len(used)
        if not linked and 16 * len(at) < size:
            linked = True
            nxt, prv, gone = np.arange(1, size + 1), np.arange(-1, size), np.zeros(size + 1, dtype=bool)
            again = np.zeros(size + 1, dtype=bool)
        seq[at] = name[own]
        if linked:
            rank[hit] = free
            out = nxt[at]
            nxt[at], prv[nxt[out]], gone[out] = nxt[out], at, True
            # counted again: frequent pairs that lost, and what is beside new symbols
            again[hit] = again[look[odd]] = again[at] = again[prv[at]] = True
            look = np.flatnonzero(again[:-1])
            again[look] = again[-1] = False
            look = look[~gone[look] & (nxt[look] < size)]
        else:
            keep = np.ones(size, dtype=bool)
            keep[at + 1] = False
            seq = seq[keep]
            rank = rank[: len(seq) + 2]
            rank.fill(free)
            look = every[: len(seq) - 1]
    if linked:
        seq = seq[~gone[:-1]]
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), lengths


def _length(symbols: np.ndarray, first: int, lengths: np.ndarray) -> np.ndarray:
    """Ids below each symbol; of a pair the sum."""
    table = np.concatenate((np.ones(first, dtype=np.uint32), lengths))
    found = table[symbols]
    return found.sum(axis=1, dtype=np.uint32) if symbols.ndim == 2 else found


def _planes(seq: np.ndarray, bits: int) -> list[np.ndarray]:
    """The low 16 bits of each symbol, then a plane of packed bits for each bit above."""
    high = (seq >> np.uint32(16)).astype(np.uint16)
    return [seq.astype("<u2"), *(np.packbits((high >> np.uint16(b)) & np.uint16(1) != 0) for b in range(bits - 16))]


def shard_bytes(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray, first: int, **how) -> bytes:
    seq, rules, lengths = compress(ids, first, **how)
    spans = _length(seq, first, lengths)
    starts = np.concatenate(([0], np.cumsum(spans, dtype=np.uint64)[:-1])).astype("<u8") if len(seq) else np.zeros(0, "<u8")
    bits = max(16, int(seq.max(initial=0)).bit_length())
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    head = np.array([MAGIC, first, len(doc_ids), len(rules), len(seq), len(ids), bits, STEP, int(nulls.sum())], dtype="<u8")
    known = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    parts = (head, known, nulls, ends.astype("<u8"), rules.astype("<u4"), lengths.astype("<u4"), starts[::STEP], *_planes(seq, bits))
    return b"".join(p.tobytes() for p in parts)


def _gather(symbols: np.ndarray, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ids of all symbols one after another."""
    n = length[symbols]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.arange(total, dtype=kind)
    at += np.repeat((start[symbols] - (ends - n)).astype(kind), n)
    return flat[at]


class Shard:
    """A decoded view of a shard's bytes."""

    def __init__(self, data: bytes):
        head = np.frombuffer(data, "<u8", _HEADER)
        if int(head[0]) != MAGIC:
            raise ValueError("not a grammar shard")
        self.first, docs, rules, symbols, self.n_ids, bits, self.step, _ = (int(x) for x in head[1:])
        at = 8 * _HEADER

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        known, nulls = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(known, nulls)]
        self.ends = take("<u8", docs).astype(np.int64)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.lengths = take("<u4", rules)
        self.samples = take("<u8", -(-symbols // self.step)).astype(np.int64)
        self.low = take("<u2", symbols)
        self.high = [take("u1", -(-symbols // 8)) for _ in range(bits - 16)]

    def symbols(self, start: int, stop: int) -> np.ndarray:
        """Symbols from ``start``, a multiple of the sample step, to ``stop``."""
        found = self.low[start:stop].astype(np.uint32)
        for b, plane in enumerate(self.high):
            bits = np.unpackbits(plane[start // 8 : -(-stop // 8)], count=len(found))
            found |= bits.astype(np.uint32) << np.uint32(16 + b)
        return found

    def _expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All rules expanded once: flat ids, and each symbol's start and length in them. Rules
        that use only symbols before them are expanded together."""
        length = np.concatenate((np.ones(self.first, np.int64), self.lengths.astype(np.int64)))
        start = np.concatenate(([0], np.cumsum(length)[:-1]))
        flat = np.empty(int(length.sum()), dtype="<u4")
        flat[: self.first] = np.arange(self.first)
        highest = np.maximum.accumulate(self.rules.max(axis=1)) if len(self.rules) else self.rules
        done = 0
        while done < len(self.rules):
            known = self.first + done
            upto = int(np.searchsorted(highest, known, "left"))
            if upto <= done:
                raise ValueError("a rule of the shard uses itself or a later one")
            got = _gather(self.rules[done:upto].ravel(), flat, start, length)
            flat[start[known] : start[known] + len(got)] = got
            done = upto
        return flat, start, length

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_flat"):
            self._flat = self._expansions()
        return _gather(symbols, *self._flat)

    def all_ids(self) -> np.ndarray:
        return self._expand(self.symbols(0, len(self.low)))

    def read(self, start: int, length: int) -> np.ndarray:
        """Ids ``start`` to ``start + length`` of the shard, from the symbols around them only."""
        stop = min(start + length, self.n_ids)
        if stop <= start:
            return np.zeros(0, dtype="<u4")
        a = int(np.searchsorted(self.samples, start, "right")) - 1
        b = int(np.searchsorted(self.samples, stop, "left"))
        got = self._expand(self.symbols(a * self.step, min(b * self.step, len(self.low))))
        base = int(self.samples[a])
        return got[start - base : stop - base]

    def document(self, k: int) -> np.ndarray:
        start = int(self.ends[k - 1]) if k else 0
        return self.read(start, int(self.ends[k]) - start)


SHARDS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()),
    T.StructField("start_in_part", T.LongType()), T.StructField("n_ids", T.LongType()),
    T.StructField("n_docs", T.LongType()), T.StructField("shard", T.BinaryType()),
])


def write_shards(docs: DataFrame, tokenizer: str, path: str, *, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = 0, shard_ids: int = 1 << 20, least: int = 8) -> None:
    """Encode every text, end it with ``end_id`` and write grammar shards to ``path``.

    Documents are dealt by ranges of their id, so the files' order is the ids' order and
    each task compresses its own range; many rows without an id, or of one id, are dealt by
    their place in the table. A shard is closed at ``shard_ids`` ids.
    """
    ship(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bytetokens.coder(tokenizer)
        vocabulary = coder.tok.get_vocab_size()
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        held: list[bytes] = []
        size = 0
        end = np.array([end_id], dtype="<u4").tobytes()

        def close() -> pa.RecordBatch:
            nonlocal names, held, size, seq, before
            ends = np.cumsum([len(x) // 4 for x in held])
            ids = np.frombuffer(b"".join(held), "<u4")
            blob = shard_bytes(names, ends, ids, vocabulary, least=least)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()),
                 pa.array([len(ids)], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([blob], pa.binary())],
                names=SHARDS.fieldNames())
            seq, before, names, held, size = seq + 1, before + len(ids), [], [], 0
            return row

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(keys), 512):
                part_of = texts.slice(at, 512).to_pylist()
                for key, ids in zip(keys[at : at + 512], coder.encode(part_of)):
                    names.append(key)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= shard_ids:
                        yield close()
        if names:
            yield close()

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("k"), F.col(quoted(text_col)).alias("t"))
    rows = rows.select("k", F.monotonically_increasing_id().alias("place"), "t")
    rows.repartitionByRange("k", "place").sortWithinPartitions("k", "place").select("k", "t").mapInArrow(pack, SHARDS).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with ``start``, the ids of all shards before; one small row per writing
    task goes through the driver."""
    shards = spark.read.schema(SHARDS).parquet(path)
    sums = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base = list(accumulate((n for _, n in sums), initial=0))
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(sums, base)], "part int, base long")
    return shards.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("start_in_part")).drop("base")


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def digests(shards: DataFrame) -> DataFrame:
    """Each document as its shard gives it back: id, global start, length and checksum."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(blob.as_buffer())
                ids = memoryview(np.ascontiguousarray(shard.all_ids(), dtype="<u4")).cast("B")
                ends = shard.ends.tolist()
                begins = [0, *ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array([start + a for a in begins], pa.int64()),
                     pa.array([b - a for a, b in zip(begins, ends)], pa.int64()),
                     pa.array([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begins, ends)], pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    ship(shards.sparkSession)
    return shards.select("start", "shard").mapInArrow(decode, DIGEST)


def encode_documents(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """Write the shards to the shared folder and return the digests read back from them."""
    path = new_path(docs.sparkSession, "repair")
    write_shards(docs, tokenizer, path, **how)
    return digests(read_shards(docs.sparkSession, path))
