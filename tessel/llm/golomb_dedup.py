"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. One pass over the texts keeps for each row a 64-bit fingerprint, the SHA-256 of the normalised text
   and its length, in a narrow table in the shared folder.
2. Every partition cuts its fingerprints to log2(rows) + 10 bits, sorts them and sends each owner (a range
   of the fingerprints) one block: gaps between neighbours, Golomb-Rice coded, about log2(partitions) +
   12 bits a row.  Copies within a partition go once.
3. Owners decode the blocks and answer each with a bitmap: which of its fingerprints another partition
   also has.
4. Partitions mark suspects by those bitmaps.  Only suspects' texts are shuffled, grouped by their bytes;
   equal texts already meet map-side, so a hot text is one row for each task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm.common import SPACES, bounded, checkpointed, fresh, same, shuffle_width, written

#: Bits that a fingerprint has beyond log2(rows): a row with no copy is suspected at a rate of 2 ** -EXTRA_BITS.
EXTRA_BITS = 10
#: Fingerprints for an owner, about; bounds the memory of the task that decodes them.
OWNER_ROWS = 200_000
#: A group is hot if it holds one of so many parts of all rows; there are HOT_PARTS hot groups at most.
HOT_PARTS = 256


def rice_encode(values: np.ndarray, width: int) -> bytes:
    """Ascending distinct integers below ``2 ** width`` as one block.

    The block has the count and the remainder's bits k (little-endian, 8 and 1 bytes), the bytes of the
    unary part (8), the quotients in unary, the remainders in k bits each.
    """
    n = len(values)
    if n == 0:
        return bytes(17)
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    k = max(0, int(math.log2(max(1.0, (1 << width) / n * math.log(2)))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    rest = gaps & np.uint64((1 << k) - 1)
    bits = ((rest[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    first = np.packbits(unary).tobytes()
    return n.to_bytes(8, "little") + bytes([k]) + len(first).to_bytes(8, "little") + first + np.packbits(bits.ravel()).tobytes()


def rice_decode(block: bytes) -> np.ndarray:
    """The integers of a block of ``rice_encode``."""
    n, k, size = int.from_bytes(block[:8], "little"), block[8], int.from_bytes(block[9:17], "little")
    if n == 0:
        return np.zeros(0, np.uint64)
    unary = np.unpackbits(np.frombuffer(block, np.uint8, size, 17))
    ends = np.flatnonzero(unary)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    gaps = quotients.astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(block, np.uint8, offset=17 + size), count=n * k).reshape(n, k)
        for j in range(k):
            gaps |= bits[:, j].astype(np.uint64) << np.uint64(j)
    return np.cumsum(gaps, dtype=np.uint64)


def _cut(hashes: np.ndarray, width: int) -> np.ndarray:
    return hashes.view(np.uint64) >> np.uint64(64 - width)


def _send(width: int, owner_bits: int):
    """A function of a partition's batches: one block for each owner that it has fingerprints for."""

    def send(batches):
        parts, got = [], []
        for b in batches:
            if b.num_rows:
                parts.append(b.column("_part")[0].as_py())
                got.append(b.column("_hash").to_numpy(zero_copy_only=False))
        if not got:
            return
        values = np.unique(_cut(np.concatenate(got), width))
        owners = (values >> np.uint64(width - owner_bits)).astype(np.int64)
        at = np.flatnonzero(np.diff(owners, prepend=-1))
        for a, b in zip(at, [*at[1:], len(values)]):
            low = np.uint64(int(owners[a]) << (width - owner_bits))
            yield pa.RecordBatch.from_pydict({"_owner": [int(owners[a])], "_part": pa.array([parts[0]], pa.int32()), "_block": [rice_encode(values[a:b] - low, width - owner_bits)]})

    return send


def _answer(blocks: pa.Table) -> pa.Table:
    """An owner's answers: for each block a bitmap of the fingerprints that other blocks have too."""
    lists = [rice_decode(x.as_py()) for x in blocks.column("_block")]
    _, place, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    twice = count[place] > 1
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    return pa.table({"_owner": blocks.column("_owner"), "_part": blocks.column("_part"), "_bits": pa.array([np.packbits(x).tobytes() for x in np.split(twice, cuts)], pa.binary())})


def _mark(width: int, owner_bits: int):
    """A function of a partition's rows and of the answers to it: the suspects among the rows."""

    def mark(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows
        values, place, count = np.unique(_cut(rows.column("_hash").to_numpy(), width), return_inverse=True, return_counts=True)
        owners = (values >> np.uint64(width - owner_bits)).astype(np.int64)
        suspect = count > 1
        for owner, bits in zip(answers.column("_owner").to_pylist(), answers.column("_bits").to_pylist()):
            a, b = np.searchsorted(owners, [owner, owner + 1])
            suspect[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        return rows.filter(pa.array(suspect[place]))

    return mark


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its group of equal texts and whether it stays.

    Texts are equal when identical without the characters space and U+0009 to U+000D; a null text counts
    as empty, so null, empty and blank texts are one group.  Of a group the row with the most code points
    in its text stays, then the one with the smallest id (null is smallest), then the first of repeated
    rows.  Only the columns named are read; an empty table gives an empty result.

    Returns the id, ``keep_id``, ``group_size`` (long), ``kept`` and ``text_sha256`` (of the normalised text).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    rows = slim.withColumn("_norm", F.regexp_replace("_text", SPACES, "")).select(
        "_id", F.monotonically_increasing_id().alias("_row"), F.spark_partition_id().alias("_part"), F.xxhash64("_norm").alias("_hash"),
        F.char_length("_text").cast("long").alias("_chars"), F.unhex(F.sha2("_norm", 256)).alias("_sha"),
    )
    rows = checkpointed(rows)
    n = rows.count()
    width = min(60, math.ceil(math.log2(max(n, 2))) + EXTRA_BITS)
    owner_bits = min(width - 1, math.ceil(math.log2(max(n / OWNER_ROWS, min(shuffle_width(spark), 1 + n / 1000), 1))))
    blocks = rows.select("_part", "_hash").mapInArrow(_send(width, owner_bits), "_owner long, _part int, _block binary")
    answers = blocks.groupBy("_owner").applyInArrow(_answer, "_owner long, _part int, _bits binary")
    suspects = written(rows.groupBy("_part").cogroup(answers.groupBy("_part")).applyInArrow(_mark(width, owner_bits), rows.schema), "suspects")

    # The texts of the suspects, by their bytes.  Two texts of one SHA-256 would end the job.
    ids = suspects.select(F.col("_id").alias("_suspect")).distinct()
    texts = slim.join(bounded(ids, suspects.count(), 40), same(F.col("_id"), F.col("_suspect")), "left_semi")
    texts = texts.groupBy(F.regexp_replace("_text", SPACES, "").alias("_norm")).agg(F.count("*").alias("_n"))
    verified = texts.groupBy(F.unhex(F.sha2("_norm", 256)).alias("_sha")).agg(F.count("*").alias("_texts"))
    groups = suspects.groupBy("_sha").agg(F.count("*").alias("_size"), F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").alias("i"), F.col("_row").alias("r"))).alias("_best"))
    groups = groups.filter("_size > 1").join(verified, "_sha").select(
        "_sha", F.when(F.col("_texts") == 1, F.col("_size")).otherwise(F.raise_error(F.lit("two texts have one SHA-256"))).alias("_size"),
        F.col("_best.i").alias("_keep"), F.col("_best.r").alias("_first"),
    )
    groups = written(groups, "groups")
    hot = F.broadcast(groups.filter(F.col("_size") * HOT_PARTS >= n))
    cold = groups.filter(F.col("_size") * HOT_PARTS < n)
    both = rows.join(hot, "_sha").unionByName(rows.join(hot.select("_sha"), "_sha", "left_anti").join(cold, "_sha", "left"), allowMissingColumns=True)
    alone = F.col("_size").isNull()
    return both.select(
        F.col("_id").alias(id_col), F.when(alone, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_row") == F.col("_first"))).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that ``exact_dedup`` keeps."""
    own, rank = fresh(docs, "_own"), fresh(docs, "_rank")
    found = exact_dedup(docs, id_col, text_col).select(F.col(id_col).alias(own), "kept")
    marks = found.groupBy(own).agg(F.count_if("kept").alias("_stay"), F.count("*").alias("_all")).filter("_stay < _all")
    marks = written(marks, "marks")
    n = marks.count()
    gone, some = marks.filter("_stay = 0").select(own), marks.filter("_stay > 0").select(own)
    out = docs.join(bounded(gone, n, 16), same(F.col(id_col), F.col(own)), "left_anti")
    if some.count():  # an id that copies share: of each of its texts the row with the most code points
        rows = out.join(bounded(some, n, 16), same(F.col(id_col), F.col(own)), "left_semi")
        by = Window.partitionBy(id_col, F.xxhash64(F.regexp_replace(F.coalesce(text_col, F.lit("")), SPACES, ""))).orderBy(F.char_length(text_col).desc_nulls_last(), text_col)
        one = rows.withColumn(rank, F.row_number().over(by)).filter(F.col(rank) == 1).drop(rank)
        out = out.join(bounded(some, n, 16), same(F.col(id_col), F.col(own)), "left_anti").unionByName(one)
    return out
