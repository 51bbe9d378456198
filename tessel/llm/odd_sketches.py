"""Near-duplicates by MinHash bands, odd sketches and exact verification.

Each text's word shingles give SAMPLES MinHash values.  BANDS bands of ROWS values each find candidates; the
same samples folded into a bitmap of parities (an odd sketch) tell how alike two texts are from the XOR of
their bitmaps, precisely where they are very alike.  Candidates whose sketches are near are verified on
their full shingle sets.

Two texts of similarity 0.8 share no band with probability (1 - 0.8 ** 5) ** 32 = 3e-6.

Groups aren't expanded into pairs.  First each text of a band's bucket is compared with the bucket's first
one, and links are joined into components.  A bucket that is in one component then has no more to tell.
In the others texts of different components are compared where they meet, each pair in one bucket alone: first by
sketch, then, for those that are near to any, on their sets, and only as long as they are in different components.
A bucket that is too large is cut in blocks; texts of its largest component don't meet one another.  What comes out are
links that join components, no pairs, and a text's set is sent once to each of its open buckets (BANDS at most) and
once more for each block of a bucket that is cut.

Sets are made anew from the texts that may be needed by a filter of their ids, of bounded size; a join with the
ids themselves then leaves the ones that are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import bounded, fresh, hot_join, released, small_batches, written
from tessel.llm.components import components

ROWS, BANDS = 5, 32
SAMPLES = ROWS * BANDS
#: Bits of an odd sketch.
BITS = 256
#: Estimates of similarity have a standard deviation of about 0.05 at 0.8; below this one a pair isn't verified.
LEAST_ESTIMATE = 0.55
#: A block has about so many texts at most, and so many bytes of sets; a task compares two blocks.
BLOCK, BLOCK_BYTES = 3000, 32 << 20
#: A bucket is hot if it holds one of so many parts of all rows of buckets.
HOT_BUCKETS = 1 << 14
#: A group of equal sets is hot if it holds one of so many parts of all rows.
HOT_PARTS = 256
MEMORY = 300_000
#: A filter of ids has about so many bits for each, in parts of so many words (of 64 bits), and so many parts at most: 8 MB.
BITS_AN_ID, FILTER_WORDS, FILTER_PARTS = 16, 1024, 1024

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.random.Generator(np.random.PCG64(20_240_117)).integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPOT = np.random.Generator(np.random.PCG64(7_654_321)).integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Numbers(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], size: int, numbers: dict | None = None) -> list[np.ndarray]:
    """Of each text (UTF-8) the sorted distinct 64-bit hashes of its shingles of ``size`` words.

    A-Z are lower-cased.  A text of fewer words has one shingle of all; one without words has none.
    """
    numbers = _Numbers() if numbers is None else numbers
    words = [x.translate(_LOWER).split() for x in texts]
    flat = np.fromiter((numbers[w] for x in words for w in x), np.uint64, sum(map(len, words)))
    out, at = [], 0
    for x in words:
        own = flat[at : at + len(x)]
        at += len(x)
        k = min(size, len(own))
        if not k:
            out.append(own)
            continue
        hashes = np.full(len(own) - k + 1, k, np.uint64)
        for j in range(k):
            hashes = _mix(hashes * np.uint64(0x9E3779B97F4A7C15) + own[j : len(own) - k + 1 + j])
        out.append(np.unique(hashes))
    return out


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES minima [set, sample] of sets that aren't empty."""
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate(sets)
    out = np.empty((len(sets), SAMPLES), np.uint32)
    for j in range(SAMPLES):
        out[:, j] = np.minimum.reduceat((flat * _ODD[j]) >> np.uint64(32), starts)
    return out


def odd_sketch(minima: np.ndarray) -> np.ndarray:
    """Parities [set, word of 64 bits]: each sample flips the bit that it hashes to."""
    spots = (_mix(minima.astype(np.uint64) + _SPOT) >> np.uint64(56)).astype(np.int64) % BITS
    parity = np.zeros((len(minima), BITS), np.uint8)
    rows = np.arange(len(minima))
    for j in range(SAMPLES):
        parity[rows, spots[:, j]] ^= 1
    return np.packbits(parity, axis=1).view(np.int64)


def bands(minima: np.ndarray) -> np.ndarray:
    """Hashes [set, band] of the bands' values, different from band to band."""
    parts = minima.astype(np.uint64).reshape(len(minima), BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(minima), axis=0)
    for j in range(ROWS):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return out.view(np.int64)


#: XORs with more bits than this tell of a similarity under LEAST_ESTIMATE: of 2 * SAMPLES * (1 - s) samples
#: in one set alone, each flips a bit.
MOST_BITS = int(BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * SAMPLES * (1 - LEAST_ESTIMATE))))


def _signatures(size: int):
    def run(batches):
        numbers = _Numbers()
        for b in small_batches(batches):
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= 250_000):
                    chars += len(texts[end])
                    end += 1
                sets = shingle_sets(texts[at:end], size, numbers)
                full = [k for k, x in enumerate(sets) if len(x)]
                marks: list = [None] * len(sets)
                buckets: list = [None] * len(sets)
                if full:
                    minima = min_hashes([sets[k] for k in full])
                    for k, mark, bucket in zip(full, odd_sketch(minima), bands(minima)):
                        marks[k], buckets[k] = mark, bucket
                digests = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, end - at), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(marks, pa.list_(pa.int64())), pa.array(buckets, pa.list_(pa.int64())),
                    ],
                    ["_id", "_n", "_digest", "_sketch", "_bands"],
                )
                at = end

    return run


def _sets(size: int):
    def run(batches):
        numbers = _Numbers()
        for b in small_batches(batches):
            sets = shingle_sets([x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()], size, numbers)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["_node", "_digest", "_set"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have ``100 * intersection >= percent * union``."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verify(percent: int):
    """Pairs whose sets have ``100 * intersection >= percent * union``."""

    def run(batches):
        for b in small_batches(batches):
            good = []
            for x, y in zip(b.column("_x"), b.column("_y")):
                good.append(_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], ["a", "b"])

    return run


def _near(x: Column, y: Column) -> Column:
    """Whether two sketches differ in MOST_BITS at most."""
    return sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(BITS // 64)), F.lit(0)) <= MOST_BITS


#: A text in a task (a bucket, or two blocks of one): its side there, and the open buckets that it is in.
MEMBER = "_band long, _k int, _i int, _j int, _side boolean, _node long, _root long, _n long, _sketch array<long>, _open array<long>"
_TASK = ["_band", "_k", "_i", "_j"]


def _tasks(rows: pa.Table):
    """The tasks among the rows of a group: numbers of the rows of each."""
    key = [rows.column(x).to_numpy() for x in _TASK]
    order = np.lexsort(key[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in key:
        new[1:] |= x[order[1:]] != x[order[:-1]]
    return np.split(order, np.flatnonzero(new)[1:])


def _met(band: int, opens: list[np.ndarray]) -> np.ndarray:
    """Bits [text, word] of the open buckets before ``band`` that several texts of a task share: there they meet too."""
    sizes = np.array([len(x) for x in opens])
    flat, own = np.concatenate(opens), np.repeat(np.arange(len(opens)), sizes)
    early = flat < band
    found, place, count = np.unique(flat[early], return_inverse=True, return_counts=True)
    many = np.flatnonzero(count > 1)
    number = np.full(len(found), -1)
    number[many] = np.arange(len(many))
    bits = np.zeros((len(opens), -(-max(1, len(many)) // 64) * 64), np.uint8)
    use = number[place] >= 0
    bits[own[early][use], number[place][use]] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def _meetings(rows: pa.Table, percent: int):
    """For each text of each task, its row, and the rows of those that it has to be compared with by size and sketch.

    A pair meets in the first of its common buckets; texts of one component are left out (``root`` may change meanwhile).
    """
    node, root, side, size = (rows.column(x).to_numpy(zero_copy_only=False) for x in ("_node", "_root", "_side", "_n"))
    root = root.copy()
    sketch = np.concatenate([np.zeros(0, np.int64), rows.column("_sketch").combine_chunks().flatten().to_numpy()]).reshape(len(node), -1).view(np.uint64)
    opens = rows.column("_open").combine_chunks()
    cuts, flat = opens.offsets.to_numpy(), opens.values.to_numpy()
    band, kind = rows.column("_band").to_numpy(), rows.column("_k").to_numpy()
    for task in _tasks(rows):
        if (root[task] == root[task[0]]).all():
            continue
        met = _met(int(band[task[0]]), [flat[cuts[k] : cuts[k + 1]] for k in task.tolist()])
        two = kind[task[0]] == 1
        left = np.flatnonzero(side[task]) if two else np.arange(len(task))
        right = np.flatnonzero(~side[task]) if two else left
        for k in left.tolist():
            own = task[k]
            others = right if two else right[node[task[right]] > node[own]]
            at = task[others]
            good = (root[at] != root[own]) & (100 * np.minimum(size[at], size[own]) >= percent * np.maximum(size[at], size[own])) & ~(met[others] & met[k]).any(axis=1)
            at = at[good]
            yield own, at[np.bitwise_count(sketch[at] ^ sketch[own]).sum(axis=1) <= MOST_BITS], root


def _survivors(percent: int):
    """The rows of texts that have a near one by sketch, as they are."""

    def run(rows: pa.Table) -> pa.Table:
        keep = np.zeros(rows.num_rows, bool)
        for own, near, _ in _meetings(rows, percent):
            keep[near] = True
            keep[own] |= len(near) > 0
        out = rows.filter(pa.array(keep)).drop_columns(["_group"])
        return out.cast(pa.schema([pa.field(f.name, pa.list_(pa.int64()) if pa.types.is_list(f.type) else f.type) for f in out.schema]))

    return run


def _compare(percent: int):
    """The links that join components among the texts of each task, on their sets."""

    def run(rows: pa.Table) -> pa.Table:
        sets = rows.column("_set")
        node = rows.column("_node").to_numpy()
        a, b = [], []
        for own, near, root in _meetings(rows, percent):
            x = np.frombuffer(sets[int(own)].as_buffer(), np.uint64) if len(near) else None
            for m in near.tolist():
                if root[m] != root[own] and _linked(x, np.frombuffer(sets[m].as_buffer(), np.uint64), percent):
                    root[root == root[m]] = root[own]
                    a.append(max(node[own], node[m]))
                    b.append(min(node[own], node[m]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _filter_part(rows: pa.Table) -> pa.Table:
    """The words of one part of a filter of ids."""
    hashes = rows.column("_hash").to_numpy().view(np.uint64)
    words = np.zeros(FILTER_WORDS, np.uint64)
    bits = [np.uint64(1) << ((hashes >> np.uint64(k)) & np.uint64(63)) for k in _FILTER_BITS]
    np.bitwise_or.at(words, ((hashes >> np.uint64(20)) % np.uint64(FILTER_WORDS)).astype(np.int64), np.bitwise_or.reduce(bits))
    return pa.table({"_part": rows.column("_part").slice(0, 1), "_words": pa.array([words.view(np.int64)], pa.list_(pa.int64()))})


#: Of an id's hash the lowest 20 bits tell the part, the next ones the word, and six from each of these on a bit in it.
_FILTER_BITS = (40, 46, 52, 58)


def maybe_among(rows: DataFrame, id_col: str, ids: DataFrame, count: int) -> DataFrame:
    """The rows of ``rows`` whose id is among the ``count`` ones of ``ids`` (its one column), and a few others.

    A Bloom filter of the ids is broadcast, made by the executors: the driver holds FILTER_PARTS parts at most, whatever
    the count.  Beyond 4 million ids more of the other rows come through.
    """
    parts = min(FILTER_PARTS, 1 << max(0, count * BITS_AN_ID // (64 * FILTER_WORDS)).bit_length())
    part = lambda x: F.col(x).bitwiseAND(F.lit(parts - 1))
    made = ids.toDF("_id").select(F.xxhash64("_id").alias("_hash")).withColumn("_part", part("_hash")).groupBy("_part").applyInArrow(_filter_part, "_part long, _words array<long>")
    own = fresh(rows, "_hash")
    bits = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({own}, {k}) & 63 as int))" for k in _FILTER_BITS)
    word = F.expr(f"get(_words, cast(shiftrightunsigned({own}, 20) % {FILTER_WORDS} as int))")
    asked = rows.withColumn(own, F.xxhash64(id_col))
    return asked.join(F.broadcast(made), (part(own) == F.col("_part")) & (word.bitwiseAND(F.expr(bits)) == F.expr(bits)), "left_semi").drop(own)


def numbered(docs: DataFrame, id_col: str, name: str) -> tuple[DataFrame, int | None]:
    """``docs`` with its ids as numbers in a column ``name``, and the first number that is no id (null: there is none).

    Rows without an id get numbers beyond all ids, each its own.  Only then the table is written first, so that
    these numbers stay.
    """
    row = docs.agg(F.max(F.col(id_col).cast("long")).alias("most"), F.count_if(F.col(id_col).isNull()).alias("none")).first()
    own = F.col(id_col).cast("long")
    if not row["none"]:
        return docs.withColumn(name, own), None
    base = 0 if row["most"] is None else max(0, row["most"] + 1)
    return written(docs.withColumn(name, F.coalesce(own, F.lit(base) + F.monotonically_increasing_id())), "numbered"), base


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the size of its shingle set and its component.

    Words are runs of other characters than space and U+0009 to U+000D, with A-Z lower-cased.  A set is the
    distinct shingles of ``shingle`` words; a text of fewer words has one of all.  Texts are linked if
    ``100 * intersection >= percent * union``; one without words is linked with nothing.  Rows that share an
    id are one document with both texts.  Ids are integers.  A row without an id is a document of its own that comes
    after all others: its ``component_id`` is the smallest id reachable, null if there is none, and of a component
    without ids one row is kept.  An empty table gives no rows.

    Returns the id, ``n_shingles``, ``component_id`` (the smallest id reachable) and ``kept`` (whether it is
    the id itself).
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    slim, base = numbered(docs.select(F.col(id_col).alias("_own"), F.col(text_col).cast("string").alias("_text")), "_own", "_id")
    slim = slim.select("_id", "_text")
    signs = written(slim.mapInArrow(_signatures(shingle), "_id long, _n long, _digest binary, _sketch array<long>, _bands array<long>"), "signatures")
    # one node for all rows of one set
    nodes = signs.filter("_digest IS NOT NULL").groupBy("_digest").agg(F.min("_id").alias("_node"), F.first("_n").alias("_n"), F.first("_sketch").alias("_sketch"), F.first("_bands").alias("_bands"), F.count("*").alias("_rows"))
    nodes = written(nodes, "nodes")
    buckets = nodes.select("_node", "_n", F.explode("_bands").alias("_band"))
    firsts = written(buckets.groupBy("_band").agg(F.count("*").alias("_size"), F.min("_node").alias("_first")).filter("_size > 1"), "firsts")
    large = lambda n, size: F.col(size) * HOT_BUCKETS >= n
    shared = written(hot_join(buckets, firsts, ["_band"], large(nodes.count() * BANDS, "_size")), "buckets")
    released(spark)

    def sets_of(names: DataFrame) -> DataFrame:
        """``_node`` and ``_set`` of distinct ``_node``: their texts are read again."""
        wanted = written(nodes.select("_node", "_digest").join(names, "_node"), "wanted")
        texts = maybe_among(slim, "_id", wanted.select("_node"), wanted.count())
        sets = texts.mapInArrow(_sets(shingle), "_node long, _digest binary, _set binary").join(wanted, ["_node", "_digest"], "left_semi")
        out = written(sets.dropDuplicates(["_node", "_digest"]).select("_node", "_set"), "sets")
        released(spark)
        return out

    def confirm(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b) of nodes, on their full sets."""
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("_node")).distinct())
        full = pairs.join(sets.select(F.col("_node").alias("a"), F.col("_set").alias("_x")), "a").join(sets.select(F.col("_node").alias("b"), F.col("_set").alias("_y")), "b")
        return written(full.mapInArrow(_verify(percent), "a long, b long"), "links")

    # Each node against the first of each of its buckets.
    sketches = nodes.select("_node", "_sketch")
    pairs = shared.filter("_node <> _first").select(F.col("_node").alias("a"), F.col("_first").alias("b")).distinct()
    pairs = pairs.join(sketches.select(F.col("_node").alias("a"), F.col("_sketch").alias("_x")), "a").join(sketches.select(F.col("_node").alias("b"), F.col("_sketch").alias("_y")), "b")
    links = confirm(written(pairs.filter(_near(F.col("_x"), F.col("_y"))).select("a", "b"), "pairs"))

    # Buckets of three or more that are not yet in one component, each with its largest component.
    roots = components(links)
    released(spark)
    rooted = shared.filter("_size > 2").join(roots.withColumnRenamed("node", "_node"), "_node", "left").select("_band", "_node", "_n", F.coalesce("root", "_node").alias("_root"))
    rooted = written(rooted, "rooted")
    by_root = rooted.groupBy("_band", "_root").agg(F.count("*").alias("_r"), F.sum("_n").alias("_s")).groupBy("_band")
    open_ = by_root.agg(F.count("*").alias("_roots"), F.max(F.struct("_r", "_root", "_s")).alias("_major"), F.sum("_r").alias("_r"), F.sum("_s").alias("_s")).filter("_roots > 1")
    pieces = lambda r, s: F.greatest(F.lit(1), F.ceil(r / BLOCK), F.ceil(8 * s / BLOCK_BYTES)).cast("int")
    open_ = open_.select("_band", "_r", F.col("_major._root").alias("_most"), pieces(F.col("_r"), F.col("_s")).alias("_all"), pieces(F.col("_major._r"), F.col("_major._s")).alias("_large"), pieces(F.col("_r") - F.col("_major._r"), F.col("_s") - F.col("_major._s")).alias("_small"))
    open_ = written(open_, "open")
    if open_.count():
        members = written(hot_join(rooted, open_, ["_band"], large(rooted.count(), "_r")), "members")
        parts = max(1, members.count() // BLOCK)
        opens = members.groupBy("_node").agg(F.collect_set("_band").alias("_open"))
        members = members.join(opens, "_node").join(sketches, "_node")
        task = lambda k, i, j: F.struct(F.lit(k).alias("_k"), i.alias("_i"), j.alias("_j"))
        minor = F.col("_root") != F.col("_most")
        own = lambda n: F.pmod(F.xxhash64("_node"), F.col(n)).cast("int")
        upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        among = F.transform(upto("_small"), lambda x: task(0, F.least(own("_small"), x), F.greatest(own("_small"), x)))
        tasks = (
            F.when(F.col("_all") == 1, F.array(task(0, F.lit(0), F.lit(0)))).when(minor, F.concat(among, F.transform(upto("_large"), lambda x: task(1, own("_small"), x))))
            .otherwise(F.transform(upto("_small"), lambda x: task(1, x, own("_large"))))
        )
        members = members.select("_band", F.explode(tasks).alias("_t"), minor.alias("_side"), "_node", "_root", "_n", "_sketch", "_open").select("_band", "_t._k", "_t._i", "_t._j", "_side", "_node", "_root", "_n", "_sketch", "_open")
        groups = lambda df: df.withColumn("_group", F.pmod(F.xxhash64(*_TASK), F.lit(parts))).groupBy("_group")
        near = written(groups(members).applyInArrow(_survivors(percent), MEMBER), "near")
        full = near.join(sets_of(near.select("_node").distinct()), "_node")
        more = written(groups(full).applyInArrow(_compare(percent), "a long, b long"), "links")
        released(spark)
        if more.count():
            roots = components(links.unionByName(more))
            released(spark)

    # Back to the rows: nodes of very many rows by broadcast (HOT_PARTS at most), the others by their digest.
    n = signs.count()
    final = nodes.select("_digest", "_node", "_rows").join(roots.withColumnRenamed("node", "_node"), "_node", "left").select("_digest", "_rows", F.coalesce("root", "_node").alias("_component"))
    final = written(final, "final")
    hot = F.broadcast(final.filter(F.col("_rows") * HOT_PARTS >= n))
    cold = final.filter(F.col("_rows") * HOT_PARTS < n)
    rows = signs.select("_id", "_n", "_digest")
    empty = rows.filter("_digest IS NULL").withColumn("_component", F.col("_id"))
    rows = rows.filter("_digest IS NOT NULL")
    out = rows.join(hot, "_digest").unionByName(rows.join(hot.select("_digest"), "_digest", "left_anti").join(cold, "_digest")).drop("_rows").unionByName(empty)
    known = lambda x: (F.col(x) if base is None else F.when(F.col(x) < base, F.col(x))).cast(kind)
    return out.select(known("_id").alias(id_col), F.col("_n").alias("n_shingles"), known("_component").alias("component_id"), (F.col("_id") == F.col("_component")).alias("kept"))


def without_near_copies(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose id is the smallest of its component.

    A row without an id goes if a row with one is in its component, or one without that comes first.
    """
    own = fresh(docs, "_own")
    docs, _ = numbered(docs, id_col, own)
    found = near_duplicates(docs, shingle, percent, own, text_col)
    mark = fresh(docs, "_gone")
    gone = written(found.filter("NOT kept").select(F.col(own).alias(mark)).distinct(), "gone")
    return docs.join(bounded(gone, gone.count(), 16), F.col(own) == F.col(mark), "left_anti").drop(own)
