"""Packing to a target mixture by deficit round-robin over source queues.

Each source is a queue of its documents' ids.  A round fills one window of the output: it adds to each
queue's deficit its quantum (its share of the window) and takes as many ids as the deficit has whole ones;
the rest of the deficit is carried to the next window.  A queue that runs dry leaves and the others share
its part.  So a queue has given ``floor(rounds * quantum)`` ids after so many rounds of a phase (the rounds
between two departures), and the place of every id in the output follows from its place in its queue:
partitions need no word from each other but where each queue stands when they begin.  That is a running sum
over partitions, which carries the deficits from partition to partition exactly.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import bounded, small_batches, written
from tessel.llm.tokens import batches_of_texts, encoder

#: Ids in a sequence, and in a window: a window has the target proportions.
SEQUENCE, WINDOW = 1024, 16 * 1024
#: Queues whose rounds are tabulated at once, and rounds at once.  More are taken in turn, to the same places.
MAX_QUEUES, MAX_ROUNDS = 128, 4096
#: Ids that are placed at once, and rows that are given on at once.
IDS, ROWS = 1 << 20, 1 << 15
#: A quantum is a whole number of 2 ** -FRACTION ids.
FRACTION = 16


class Plan(NamedTuple):
    """The queues, and for each phase the live queues' weight and its rounds (0: one that empties short queues).

    Memory grows with queues and with phases, not with their product: ``phases`` works out the rest again.  The
    weights are summed once, where the plan is made, so that all machines have the same quanta.
    """

    totals: np.ndarray
    weights: np.ndarray
    window: int
    steps: list[tuple[float, int]]

    def quanta(self, left: np.ndarray, mass: float) -> np.ndarray:
        """Each queue's quantum in 2 ** -FRACTION ids, 0 for those that are dry."""
        live = left > 0
        shares = np.where(live, self.weights, 0.0) / mass if mass > 0 else np.full(len(left), 1 / max(1, live.sum()))
        return np.where(live, np.maximum(1, (shares * self.window * (1 << FRACTION)).astype(np.int64)), 0)

    def phases(self) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        """Of each phase: ids that each queue gave before, quanta, rounds, and ids that all gave before."""
        left, out = self.totals.copy(), 0
        for mass, rounds in self.steps:
            quanta = self.quanta(left, mass)
            if not rounds:
                rounds, quanta = 1, emptying(left, quanta)
            yield self.totals - left, quanta, rounds, out
            given = rounds * quanta >> FRACTION
            left = left - given
            out += int(given.sum())


def emptying(left: np.ndarray, quanta: np.ndarray) -> np.ndarray:
    """Quanta of a round that empties the queues that have a quantum left at most."""
    return np.where(left << FRACTION <= quanta, left, np.minimum(left, np.maximum(1, quanta >> FRACTION))) << FRACTION


def plan_rounds(totals: list[int], weights: list[float], window: int = WINDOW) -> Plan:
    """The phases in which queues of ``totals`` ids with ``weights`` run dry; any number of queues."""
    plan = Plan(np.array(totals, np.int64), np.array(weights, np.float64), window, [])
    left = plan.totals.copy()
    while left.any():
        live = left > 0
        mass = math.fsum(plan.weights[live].tolist())
        quanta = plan.quanta(left, mass)
        rounds = int(((left[live] << FRACTION) // quanta[live]).min())
        given = rounds * quanta >> FRACTION
        if not given.any():
            # less than a quantum is left of some queues: one round that empties them
            rounds, given = 0, emptying(left, quanta) >> FRACTION
        plan.steps.append((mass, rounds))
        left -= given
    return plan


def _ahead(quanta: np.ndarray, r: np.ndarray, queue: np.ndarray) -> np.ndarray:
    """For each round of a phase and queue: ids of all earlier rounds, and of queues ahead in that round."""
    live = np.flatnonzero(quanta)
    column = np.searchsorted(live, queue)
    rounds, row = np.unique(r, return_inverse=True)
    out = np.empty(len(r), np.int64)
    by = np.argsort(row, kind="stable")
    ends = np.searchsorted(row[by], np.arange(0, len(rounds) + MAX_ROUNDS, MAX_ROUNDS))
    for k in range(len(ends) - 1):
        here, some = by[ends[k] : ends[k + 1]], rounds[k * MAX_ROUNDS : (k + 1) * MAX_ROUNDS, None]
        line, col = row[here] - k * MAX_ROUNDS, column[here]
        before, within, own = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64), np.zeros(len(here), np.int64)
        for j in range(0, len(live), MAX_QUEUES):
            others = quanta[live[j : j + MAX_QUEUES]]
            low = (some - 1) * others >> FRACTION
            given = (some * others >> FRACTION) - low
            upto = np.cumsum(given, axis=1)
            at = np.flatnonzero((col >= j) & (col < j + MAX_QUEUES))
            a, b = line[at], col[at] - j
            own[at] = within[a] + upto[a, b] - given[a, b]
            before += low.sum(axis=1)
            within += upto[:, -1]
        out[here] = before[line] + own
    return out


def runs(plan: Plan, queues: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs in the output of pieces of queues, each from ``starts`` on: rows (piece, first id, place, ids)."""
    one, out = 1 << FRACTION, []
    for given, quanta, rounds, base in plan.phases():
        q, before = quanta[queues], given[queues]
        a = np.maximum(starts, before) - before
        b = np.minimum(starts + lengths, before + (rounds * q >> FRACTION)) - before
        piece = np.flatnonzero(a < b)
        if not len(piece):
            continue
        a, b, q, before = a[piece], b[piece], q[piece], before[piece]
        # round r (from 1) gives the ids from floor((r - 1) q) to floor(r q)
        first, last = ((a + 1) * one + q - 1) // q, (b * one + q - 1) // q
        n = np.where(q < one, b - a, last - first + 1)  # rounds that give any
        of = np.repeat(np.arange(len(piece)), n)
        j = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        a, b, q = a[of], b[of], q[of]
        r = np.where(q < one, ((a + 1 + j) * one + q - 1) // q, first[of] + j)
        low, high = (r - 1) * q >> FRACTION, r * q >> FRACTION
        x, y = np.maximum(low, a), np.minimum(high, b)
        out.append(np.stack([piece[of], before[of] + x, base + _ahead(quanta, r, queues[piece][of]) + x - low, y - x], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


def places(plan: Plan, queue: int, start: int, length: int) -> list[tuple[int, int, int]]:
    """Runs of a queue's ids ``start`` to ``start + length`` in the output: (first id, place, ids)."""
    return [tuple(x[1:]) for x in runs(plan, *(np.array([x], np.int64) for x in (queue, start, length))).tolist()]


def sequences(got: np.ndarray) -> np.ndarray:
    """The rows of ``runs`` cut where a sequence of the output ends."""
    piece, first, at, size = got.T
    n = (at + size - 1) // SEQUENCE - at // SEQUENCE + 1
    of = np.repeat(np.arange(len(got)), n)
    j = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    x = np.maximum(at[of], (at[of] // SEQUENCE + j) * SEQUENCE)
    y = np.minimum(at[of] + size[of], (at[of] // SEQUENCE + j + 1) * SEQUENCE)
    return np.stack([piece[of], first[of] + x - at[of], x, y - x], axis=1)


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, weights: dict | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_ids: bool = False) -> DataFrame:
    """The pieces of all documents in sequences of SEQUENCE ids, mixed by source.

    A document's ids are those of its text (null: empty) and ``end_id``.  ``weights`` gives each source's
    target proportion; sources without one get none until the others are dry, and by default each has the
    proportion that it has in ``docs``, so that all queues end together.  A null source is a source.  All
    sequences but the last are full.  Repeated rows are packed as often as they are there; an empty table
    gives no rows.

    Returns for each piece the id, ``source``, ``start`` (ids of its document before it), ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and, if asked for, ``ids`` (u32, little-endian).
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.spark_partition_id().alias("_part"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), F.col(text_col).cast("string").alias("_text"))

    def encode(batches):
        enc, given = encoder(tokenizer), {}
        end = np.array([end_id], enc.type).tobytes()
        for b in small_batches(batches, keep=True):
            texts = [x or "" for x in b.column("_text").to_pylist()]
            sources = b.column("_source").to_pylist()
            for a, z in batches_of_texts(texts):
                ids = [x + end for x in enc.encode_many(texts[a:z])]
                sizes = [len(x) // enc.type.itemsize for x in ids]
                before = []
                for s, n in zip(sources[a:z], sizes):
                    before.append(given.get(s, 0))
                    given[s] = before[-1] + n
                part = b.slice(a, z - a)
                yield pa.RecordBatch.from_arrays([part.column("_part"), part.column("_id"), part.column("_source"), pa.array(before, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], ["_part", "_id", "_source", "_before", "_n", "_ids"])

    ids = written(slim.mapInArrow(encode, f"_part int, _id {kind}, _source string, _before long, _n long, _ids binary"), "ids")

    # Where each queue stands when a partition begins: one row for each (partition, source).
    sums = written(ids.groupBy("_source", "_part").agg(F.sum("_n").alias("_n")), "sums")
    totals = {r["_source"]: r["n"] for r in sums.groupBy("_source").agg(F.sum("_n").alias("n")).collect()}
    names = sorted(totals, key=lambda x: (x is None, x))
    target = [totals[x] if weights is None else weights.get(x, 0.0) for x in names]
    plan = plan_rounds([totals[x] for x in names], target)
    index = {x: i for i, x in enumerate(names)}
    inside = Window.partitionBy("_source").orderBy("_part")
    starts = sums.withColumn("_stand", F.sum("_n").over(inside) - F.col("_n")).select(F.col("_part").alias("_p"), F.col("_source").alias("_s"), "_stand")
    starts = written(starts, "starts")
    joined = ids.join(bounded(starts, starts.count(), 64), (F.col("_part") == F.col("_p")) & F.col("_source").eqNullSafe(F.col("_s")))

    def cut(batches):
        width = encoder(tokenizer).type
        names = ["_id", "source", *(x.split()[0] for x in PIECES.split(", ")), *["ids"] * with_ids]
        for b in small_batches(batches, keep=True):
            queue = np.array([index[x] for x in b.column("_source").to_pylist()], np.int64)
            begin, size = b.column("_stand").to_numpy() + b.column("_before").to_numpy(), b.column("_n").to_numpy()
            # parts of documents, of IDS ids at most, and as many of them at once
            n = (size + IDS - 1) // IDS
            doc = np.repeat(np.arange(len(size)), n)
            skip = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * IDS
            some = np.minimum(size[doc] - skip, IDS)
            group = np.cumsum(some) // IDS
            for at in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(group)) + 1):
                own = doc[at]
                rows = sequences(runs(plan, queue[own], begin[own] + skip[at], some[at]))
                rows = rows[np.argsort(rows[:, 0], kind="stable")]
                own = own[rows[:, 0]]
                rows[:, 1] -= begin[own]
                for a in range(0, len(rows), ROWS):
                    yield pieces(b, width, own[a : a + ROWS], *rows[a : a + ROWS, 1:].T, names)

    def pieces(b, width, own, start, place, size, names):
        blobs, last, wide, crcs, data = b.column("_ids"), -1, b"", [], []
        for k, p, n in zip(own.tolist(), start.tolist(), size.tolist()):
            if k != last:
                last, wide = k, np.frombuffer(blobs[k].as_buffer(), width).astype("<u4").tobytes()
            bits = wide[4 * p : 4 * (p + n)]
            crcs.append(zlib.crc32(bits))
            if with_ids:
                data.append(bits)
        take = pa.array(own, pa.int64())
        arrays = [b.column("_id").take(take), b.column("_source").take(take), pa.array(start), pa.array(size), pa.array(crcs, pa.int64()), b.column("_n").take(take), pa.array(place // SEQUENCE), pa.array(place % SEQUENCE)]
        return pa.RecordBatch.from_arrays(arrays + ([pa.array(data, pa.binary())] if with_ids else []), names)

    out = joined.select("_id", "_source", "_stand", "_before", "_n", "_ids").mapInArrow(cut, f"_id {kind}, source string, {PIECES}" + ", ids binary" * with_ids)
    return out.withColumnRenamed("_id", id_col)
