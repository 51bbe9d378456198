"""A store of token ids in shards that Re-Pair compresses.

A shard's ids are a sequence.  A round counts its neighbouring pairs, gives each of the most frequent ones a
new symbol (a nonterminal) and replaces them from left to right; rounds follow until no pair is frequent enough
or, where symbols have two bytes, those are used up.  A rule is the pair of symbols that a nonterminal stands for; with each rule its expansion's
length is stored, so that a reader finds a place of the sequence without expanding what lies before it.

The file format: a Parquet table, one row for each shard, written by Spark.  ``part`` and ``seq`` order the
shards, ``start`` counts the ids before the shard in its part, ``doc_ids`` and ``doc_tokens`` list its
documents and ``payload`` holds the ids, all numbers little-endian:

    magic ``RPR1`` | first nonterminal u32 | rules u32 | symbols u64 | ids u64 | bytes of a symbol u8
    | rules: two symbols u32 each | expansion lengths u32 | symbols | ids before each STRIDE-th symbol u64
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import small_batches
from tessel.llm.tokens import batches_of_texts, encoder

#: Ids in a shard, about; a longer document is a shard alone.
SHARD_IDS = 1 << 20
#: A pair is replaced if it is there at least so often: a rule takes 12 bytes, a pair that goes saves 2 to 4.
MIN_COUNT = 8
#: Pairs replaced in a round, at most.
PAIRS_A_ROUND = 8000
#: Symbols of two bytes, ids included.  A vocabulary that leaves fewer than PAIRS_A_ROUND of them may
#: have symbols of three or four bytes, and as many as pairs give.
MAX_SYMBOLS = 1 << 16
STRIDE = 1024

_HEAD = struct.Struct("<4sIIQQB")


def _half(x: np.ndarray) -> np.unsignedinteger:
    """The bits of a symbol in a pair."""
    return x.dtype.type(4 * x.itemsize)


def _bucket(pairs: np.ndarray) -> np.ndarray:
    """One of 1 << 18 buckets for each pair."""
    if pairs.dtype == np.uint32:
        return ((pairs * np.uint32(2654435761)) >> np.uint32(14)).astype(np.int32)
    return ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int32)


def _frequent(seq: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent pairs, the places of ``seq`` where they begin and which is there.

    Pairs are left << 16 | right of 32 bits, or left << 32 | right of 64 if ``seq`` is of 64-bit symbols.
    Pairs are counted in hashed buckets first, exactly only in the buckets with the highest counts.  A bucket
    gives its most frequent pair; another one of it waits for a later round.
    """
    keys = (seq[:-1] << _half(seq)) | seq[1:]
    buckets = _bucket(keys)
    held = np.bincount(buckets, minlength=1 << 18)
    least = MIN_COUNT
    if np.count_nonzero(held >= MIN_COUNT) > room:
        least = max(MIN_COUNT, int(np.partition(held, len(held) - room)[len(held) - room]))
    at = np.flatnonzero((held >= least)[buckets])
    keys, buckets = keys[at], buckets[at]
    some = np.sort(keys)
    if not len(some):
        return some, np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(np.diff(some, prepend=~some[:1]))
    pairs, counts = some[cut], np.diff(cut, append=len(some))
    by = np.argsort(counts, kind="stable")
    by = by[counts[by] >= MIN_COUNT][-room:]
    pairs = pairs[by]  # rising counts: of a bucket's pairs the last is kept
    table = np.full(1 << 18, -1, np.int32)
    own = _bucket(pairs)
    table[own] = np.arange(len(pairs))
    pairs = pairs[table[own] == np.arange(len(pairs))]
    table[_bucket(pairs)] = np.arange(len(pairs))
    if not len(pairs):
        return pairs, np.zeros(0, np.int64), np.zeros(0, np.int64)
    which = table[buckets]
    good = np.flatnonzero(which >= 0)
    good = good[pairs[which[good]] == keys[good]]
    return pairs, at[good], which[good]


def compress(ids: np.ndarray, first: int, symbols: int = MAX_SYMBOLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rules (pairs of symbols), their expansions' lengths and the sequence that is left of ``ids``.

    There are at most ``symbols`` symbols, ids included.
    """
    seq = ids.astype(np.uint32 if symbols <= 1 << 16 else np.uint64)
    rules: list[np.ndarray] = []
    lengths = np.ones(first, np.uint32)
    while len(seq) > 1:
        room = min(PAIRS_A_ROUND, symbols - len(lengths))
        if room <= 0:
            break
        pairs, at, which = _frequent(seq, room)
        if not len(pairs):
            break
        # of places that overlap, every second from the left
        fresh = np.diff(at, prepend=-2) != 1
        good = (at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0
        at, which = at[good], which[good]
        half = _half(pairs)
        made = np.stack([pairs >> half, pairs & ((pairs.dtype.type(1) << half) - pairs.dtype.type(1))], axis=1).astype(np.uint32)
        rules.append(made)
        before = len(seq)
        seq[at] = which + len(lengths)
        lengths = np.concatenate([lengths, lengths[made[:, 0]] + lengths[made[:, 1]]])
        keep = np.ones(before, bool)
        keep[at + 1] = False
        seq = seq[keep]
    return np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), lengths[first:], seq


def to_payload(ids: np.ndarray, vocabulary: int) -> bytes:
    if MAX_SYMBOLS - vocabulary >= PAIRS_A_ROUND:
        return _payload(ids, vocabulary, MAX_SYMBOLS)
    wide = _payload(ids, vocabulary, 1 << 32)
    return wide if vocabulary > MAX_SYMBOLS else min(_payload(ids, vocabulary, MAX_SYMBOLS), wide, key=len)


def _payload(ids: np.ndarray, vocabulary: int, symbols: int) -> bytes:
    rules, lengths, seq = compress(ids, vocabulary, symbols)
    width = next(w for w in (2, 3, 4) if vocabulary + len(rules) <= 1 << 8 * w)
    sizes = np.concatenate([np.ones(vocabulary, np.uint32), lengths])[seq].astype(np.uint64)
    marks = (np.cumsum(sizes) - sizes)[::STRIDE]
    head = _HEAD.pack(b"RPR1", vocabulary, len(rules), len(seq), len(ids), width)
    return b"".join([head, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), seq.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes(), marks.astype("<u8").tobytes()])


class Shard:
    """A reader of a payload.  Opening one expands nothing."""

    def __init__(self, payload: bytes):
        magic, self.first, n, symbols, self.ids, width = _HEAD.unpack_from(payload)
        if magic != b"RPR1":
            raise ValueError("not a shard of token ids")
        at = _HEAD.size
        rules = np.frombuffer(payload, "<u4", 2 * n, at).reshape(n, 2)
        lengths = np.frombuffer(payload, "<u4", n, at + 8 * n)
        seq = np.zeros((symbols, 4), np.uint8)
        seq[:, :width] = np.frombuffer(payload, np.uint8, width * symbols, at + 12 * n).reshape(symbols, width)
        self.seq = seq.view("<u4").ravel()
        self.marks = np.frombuffer(payload, "<u8", -(-symbols // STRIDE), at + 12 * n + width * symbols).astype(np.int64)
        self.rules, self.lengths = rules, np.concatenate([np.ones(self.first, np.int64), lengths.astype(np.int64)])

    def _rules(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of nonterminals, one after the other: each round puts a rule's two symbols in its place."""
        while True:
            at = np.flatnonzero(symbols >= self.first)
            if not len(at):
                return symbols
            n = np.ones(len(symbols), np.int64)
            n[at] = 2
            place = (np.cumsum(n) - n)[at]
            pair = self.rules[symbols[at] - self.first]
            symbols = np.repeat(symbols, n)
            symbols[place], symbols[place + 1] = pair[:, 0], pair[:, 1]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of symbols: each rule that is among them, or that these need, is expanded once."""
        there = np.zeros(len(self.lengths), bool)
        there[symbols] = True
        used = np.flatnonzero(there[self.first :]) + self.first
        own = self.lengths[used]
        places = np.arange(len(self.lengths))
        places[used] = self.first + np.cumsum(own) - own
        flat = np.concatenate([np.arange(self.first, dtype=np.uint32), self._rules(used).astype(np.uint32)])
        sizes = self.lengths[symbols]
        ends = np.cumsum(sizes)
        return flat[np.repeat(places[symbols] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from ``start`` to ``stop``: only the symbols there are expanded."""
        stop = self.ids if stop is None else min(stop, self.ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.marks, start, "right")) - 1  # the last mark at or before the start
        b = int(np.searchsorted(self.marks, stop, "left"))
        return self._expand(self.seq[a * STRIDE : b * STRIDE])[start - self.marks[a] : stop - self.marks[a]]


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes each text, appends ``end_id`` and writes the ids in ascending order of the ids of documents.

    A null text counts as empty.  A null id comes first; rows that share an id are ordered by their text, so
    that equal ids can be cut anywhere between parts.  An empty table gives an empty store.
    """
    kind = docs.schema[id_col].dataType

    def run(batches):
        enc, part, seq, start = encoder(tokenizer), None, 0, 0
        names, sizes, held, total = [], [], [], 0

        def shard():
            nonlocal seq, start, names, sizes, held, total
            payload = to_payload(np.frombuffer(b"".join(held), enc.type), enc.size)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "start": pa.array([start], pa.int64()), "ids": pa.array([total], pa.int64()), "doc_ids": pa.array([names], pa.list_(arrow)), "doc_tokens": pa.array([sizes], pa.list_(pa.int64())), "payload": pa.array([payload], pa.binary())})
            seq, start, names, sizes, held, total = seq + 1, start + total, [], [], [], 0
            return row

        end = np.array([end_id], enc.type).tobytes()
        for b in small_batches(batches, keep=True):
            arrow = b.column(1).type
            if part is None and b.num_rows:
                part = b.column(0)[0].as_py()
            own, texts = b.column(1).to_pylist(), [x or "" for x in b.column(2).to_pylist()]
            for a, z in batches_of_texts(texts):
                for name, ids in zip(own[a:z], enc.encode_many(texts[a:z])):
                    size = len(ids) // enc.type.itemsize + 1
                    if held and total + size > SHARD_IDS:
                        yield shard()
                    names.append(name)
                    sizes.append(size)
                    held.append(ids + end)
                    total += size
        if held:
            yield shard()

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    ranged = slim.repartitionByRange("_id", F.xxhash64("_text")).sortWithinPartitions("_id", F.xxhash64("_text"))
    ranged = ranged.select(F.spark_partition_id().alias("_part"), "_id", "_text")
    schema = f"part int, seq int, start long, ids long, doc_ids array<{kind.simpleString()}>, doc_tokens array<long>, payload binary"
    ranged.mapInArrow(run, schema).write.parquet(path)


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """Of each document of a store: id, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids``.

    ``ids`` are little-endian unsigned 32-bit integers; with ``digest``, ``ids_crc32`` of them is in their place.
    """
    shards = spark.read.parquet(path)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    # one number for each part: as many as the writer had tasks
    sums = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("ids").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sums):
        before[part] = total
        total += sums[part]

    def run(batches):
        for b in small_batches(batches, keep=True):
            for part, start, names, sizes, payload in zip(*(b.column(i) for i in range(5))):
                names, sizes = names.values, sizes.values.to_numpy().astype(np.int64)
                ids = Shard(payload.as_py()).read().astype("<u4")
                ends = np.cumsum(sizes)
                first = before[part.as_py()] + start.as_py()
                data = ids.tobytes()
                spans = zip((ends - sizes).tolist(), ends.tolist())
                if digest:
                    last = pa.array([zlib.crc32(data[4 * x : 4 * y]) for x, y in spans], pa.int64())
                else:
                    last = pa.array([data[4 * x : 4 * y] for x, y in spans], pa.binary())
                yield pa.RecordBatch.from_arrays([names, pa.array(first + ends - sizes), pa.array(sizes), last], ["_id", "start", "n_tokens", column])

    column = "ids_crc32" if digest else "ids"
    got = shards.select("part", "start", "doc_ids", "doc_tokens", "payload").mapInArrow(run, f"_id {kind}, start long, n_tokens long, {column} " + ("long" if digest else "binary"))
    return got.withColumnRenamed("_id", id_col)


