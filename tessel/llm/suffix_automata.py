"""Substring dedup by suffix automata of reference shards.

A passage is repeated if some window of ``window`` consecutive words in it also starts elsewhere.  The
reference is the corpus itself, so it is cut into shards by content: a window belongs to the smallest of its
hashes of ANCHOR words (its anchor), and equal windows have equal anchors.  Neighbouring windows of one
anchor are one segment, a string of words.

1. Anchors that the corpus has once can't have a repeated window; only the segments of the others go on.
2. Equal segments meet map-side and are counted.  A shard, the distinct segments of one anchor, becomes a
   suffix automaton with the number of times that each state's strings occur.
3. Segments are streamed through their shard's automaton.  Where the matching statistic reaches the window's
   length in a state that occurs twice or more, the window is repeated; spans are joined to maximal ones.

Broadcasting every shard to every document would compare all with all; by content each segment meets the one
shard that can have its windows.  A shard of more than SHARD_SEGMENTS distinct segments is cut further by a second
anchor, the smallest by another hash, and again by a third; its parts have automata like all others.  Only what is
still too large then is cut into single windows, which are counted as strings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import bounded, hot_join, same, small_batches, used_up, written

#: Words of a repeated window, and of an anchor.
WINDOW, ANCHOR = 35, 8
#: Distinct segments of a shard, at most; and how often one that has more is cut by another anchor.
SHARD_SEGMENTS, CUTS = 2000, 2
#: Segments in a task's group of shards, about, and their bytes.
GROUP_SEGMENTS, GROUP_BYTES = 2000, 8 << 20
MEMORY = 300_000
#: A key is hot if it has one of so many parts of all rows; there are HOT_PARTS hot keys at most.
HOT_PARTS = 1024


class Automaton:
    """A suffix automaton of several strings, with weighted counts of occurrences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]
        self.count = [0]

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else self.next[like].copy())
        self.link.append(0 if like is None else self.link[like])
        self.len.append(length)
        self.count.append(0)
        return len(self.len) - 1

    def _split(self, p: int, symbol, q: int) -> int:
        """The state of p's longest string and the symbol, taken out of q."""
        clone = self._state(self.len[p] + 1, q)
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, symbols, weight: int = 1) -> None:
        """A string that occurs ``weight`` times."""
        last = 0
        for symbol in symbols:
            p, q = last, self.next[last].get(symbol)
            if q is not None:
                last = q if self.len[p] + 1 == self.len[q] else self._split(p, symbol, q)
            else:
                last = self._state(self.len[p] + 1)
                while p >= 0 and symbol not in self.next[p]:
                    self.next[p][symbol] = last
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][symbol]
                    self.link[last] = q if self.len[p] + 1 == self.len[q] else self._split(p, symbol, q)
            self.count[last] += weight

    def finish(self) -> None:
        """Counts of all states, from the longest strings down."""
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.count[self.link[v]] += self.count[v]

    def repeated(self, symbols, window: int) -> list[int]:
        """Starts of the windows of ``symbols`` that the automaton has twice or more (after ``finish``)."""
        out, v, matched = [], 0, 0
        for end, symbol in enumerate(symbols):
            while v and symbol not in self.next[v]:
                v = self.link[v]
                matched = self.len[v]
            if symbol in self.next[v]:
                v, matched = self.next[v][symbol], matched + 1
            while self.len[self.link[v]] >= window if v else False:
                v = self.link[v]
                matched = self.len[v]
            if matched >= window and self.count[v] > 1:
                out.append(end - window + 1)
        return out


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMORY:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def segments(texts_words: list[list[bytes]], window: int, numbers: dict, cut: int = 0) -> tuple[np.ndarray, ...]:
    """The segments of the texts: number of the text, first window, windows, anchor's hash (another one for each cut)."""
    sizes = np.array([len(x) for x in texts_words], np.int64)
    total, gram = int(sizes.sum()), min(ANCHOR, window)
    none = np.zeros(0, np.int64)
    if total < window:
        return none, none, none, none
    words = np.fromiter((numbers[w] for x in texts_words for w in x), np.uint64, total)
    n = total - gram + 1
    value = np.full(n, 1, np.uint64)
    for j in range(gram):
        value = (value ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    if cut:
        value = (value ^ (value >> np.uint64(32))) * np.uint64((0xBF58476D1CE4E5B9, 0x94D049BB133111EB)[cut % 2] + 2 * cut)
        value ^= value >> np.uint64(31)
    # the least of each window's grams and its place, the first of equal ones, by doubling
    least, place, have, need = value.copy(), np.arange(n), 1, window - gram + 1
    while have < need:
        step = min(have, need - have)
        m = len(least) - step
        if m <= 0:
            break
        less = least[step:] < least[:m]
        least, place = np.where(less, least[step:], least[:m]), np.where(less, place[step:], place[:m])
        have += step
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    at = np.arange(total - window + 1)
    at = at[at + window <= ends[doc[at]]]
    if not len(at):
        return none, none, none, none
    new = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(place[at], prepend=-1) != 0) | (np.diff(doc[at], prepend=-1) != 0))
    starts = at[new]
    return doc[starts], starts - (ends - sizes)[doc[starts]], np.diff(new, append=len(at)), value[place[starts]].view(np.int64)


def _slices(texts: list[bytes], size: int = 1_000_000):
    at = 0
    while at < len(texts):
        end, have = at, 0
        while end < len(texts) and (end == at or have + len(texts[end]) <= size):
            have += len(texts[end])
            end += 1
        yield at, end
        at = end


def _lists(own: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
    """Arrays of lists: the values of each of n owners, which ascend."""
    offsets = pa.array(np.searchsorted(own, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in values]


def _anchors(window: int):
    def run(batches):
        numbers = _Numbers()
        for b in small_batches(batches):
            texts = [x or b"" for x in b.column(2).cast(pa.binary()).to_pylist()]
            for a, z in _slices(texts):
                doc, start, _, anchor = segments([x.split() for x in texts[a:z]], window, numbers)
                keep = pa.array(np.unique(doc))
                lists = _lists(doc, z - a, start.astype(np.int32), anchor)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(a, z - a).take(keep) for k in (0, 1)), *(x.take(keep) for x in lists)], ["_id", "_hash", "_starts", "_anchors"])

    return run


def _cut(window: int):
    """Of texts with the firsts of the segments that are wanted: the segments, their words joined by a space."""

    def run(batches):
        numbers = _Numbers()
        for b in small_batches(batches):
            texts = [x or b"" for x in b.column(2).cast(pa.binary()).to_pylist()]
            for a, z in _slices(texts):
                words = [x.split() for x in texts[a:z]]
                doc, start, size, anchor = segments(words, window, numbers)
                wanted = [set(x.as_py()) for x in b.column(3).slice(a, z - a)]
                pick = np.flatnonzero(np.fromiter((s in wanted[d] for d, s in zip(doc.tolist(), start.tolist())), bool, len(doc)))
                own, first, size = doc[pick], start[pick], size[pick]
                strings = [b" ".join(words[d][s : s + k + window - 1]) for d, s, k in zip(own.tolist(), first.tolist(), size.tolist())]
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(a, z - a).take(take) for k in (0, 1)), pa.array(first.astype(np.int32)), pa.array(anchor[pick]), pa.array(strings, pa.binary())], ["_id", "_hash", "_start", "_anchor", "_string"])

    return run


def _runs(starts: list[int], window: int) -> tuple[list[int], list[int]]:
    """Spans of words that the windows cover, as (from, to) lists."""
    low, high = [], []
    for s in starts:
        if high and s <= high[-1]:
            high[-1] = s + window
        else:
            low.append(s)
            high.append(s + window)
    return low, high


def _stream(window: int):
    """A group of shards: of each distinct segment the spans of its repeated windows."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_anchor")
        anchor = rows.column("_anchor").to_numpy()
        cuts = [*np.flatnonzero(np.diff(anchor, prepend=~anchor[:1])).tolist(), len(anchor)]
        strings, counts = rows.column("_string").to_pylist(), rows.column("_count").to_pylist()
        pick, lows, highs = [], [], []
        for a, z in zip(cuts, cuts[1:]):
            if z - a == 1 and counts[a] == 1:
                continue
            shard = [x.split(b" ") for x in strings[a:z]]
            if z - a == 1:
                found = [list(range(len(shard[0]) - window + 1))]  # one string, more than once
            else:
                automaton = Automaton()
                for s, n in zip(shard, counts[a:z]):
                    automaton.add(s, n)
                automaton.finish()
                found = [automaton.repeated(s, window) for s in shard]
            for k, starts in enumerate(found, a):
                if starts:
                    low, high = _runs(starts, window)
                    pick.append(k)
                    lows.append(low)
                    highs.append(high)
        some = rows.take(pa.array(pick, pa.int64()))
        return pa.table({"_anchor": some.column("_anchor"), "_text": some.column("_text"), "_low": pa.array(lows, pa.list_(pa.int32())), "_high": pa.array(highs, pa.list_(pa.int32()))})

    return run


def _windows(window: int):
    """The single windows of segments of shards that are too large."""

    def run(batches):
        for b in small_batches(batches):
            own, at, strings = [], [], []
            for k, x in enumerate(b.column("_string").to_pylist()):
                words = x.split(b" ")
                for s in range(len(words) - window + 1):
                    own.append(k)
                    at.append(s)
                    strings.append(b" ".join(words[s : s + window]))
            take = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(x).take(take) for x in ("_anchor", "_text", "_count")), pa.array(at, pa.int32()), pa.array(strings, pa.binary())], ["_anchor", "_text", "_count", "_at", "_string"])

    return run


def _recut(window: int, cut: int):
    """The parts of segments of large shards by another anchor: whose they are, from which window on, and their shard."""

    def run(batches):
        numbers = _Numbers()
        for b in small_batches(batches):
            words = [x.split(b" ") for x in b.column("_string").to_pylist()]
            own, start, size, anchor = segments(words, window, numbers, cut)
            strings = [b" ".join(words[d][s : s + k + window - 1]) for d, s, k in zip(own.tolist(), start.tolist(), size.tolist())]
            take = pa.array(own)
            outer = b.column("_anchor").take(take)
            inner = (anchor.view(np.uint64) ^ (outer.to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [outer, b.column("_text").take(take), b.column("_count").take(take), pa.array(start.astype(np.int32)), pa.array(inner), pa.array(strings, pa.binary())], ["_outer", "_whole", "_count", "_from", "_anchor", "_string"]
            )

    return run


_KEYS = ["_anchor", "_text"]


def _at_places(places: DataFrame, found: DataFrame, segments_: DataFrame, often: str) -> DataFrame:
    """``found`` at the places of its segments.  ``segments_`` has in ``often`` how many places each one has; those of
    the most are broadcast, HOT_PARTS segments at most, with as many numbers each as a segment has windows."""
    total = segments_.agg(F.sum(often)).first()[0] or 0
    hot_keys = F.broadcast(segments_.filter(F.col(often) * HOT_PARTS >= total).select(*_KEYS))
    hot = F.broadcast(found.join(hot_keys, _KEYS, "left_semi"))
    return places.join(hot, _KEYS).unionByName(places.join(hot_keys, _KEYS, "left_anti").join(found, _KEYS))


def _found(distinct: DataFrame, window: int, cut: int = 0) -> DataFrame:
    """Of distinct segments (``_anchor``, ``_text``, ``_string``, ``_count``) the spans of their repeated windows."""
    schema = "_anchor long, _text long, _low array<int>, _high array<int>"
    sizes = distinct.groupBy("_anchor").agg(F.count("*").alias("_segments"))
    large = written(sizes.filter(F.col("_segments") > SHARD_SEGMENTS).select("_anchor"), "large")
    n, size = distinct.agg(F.count("*"), F.sum(F.octet_length("_string"))).first()
    # a large shard has over SHARD_SEGMENTS rows, so there are few of them
    large_side = bounded(large, 1 + n // SHARD_SEGMENTS, 16)
    groups = max(1, -(-n // GROUP_SEGMENTS), -(-(size or 0) // GROUP_BYTES))
    small = distinct.join(large_side, "_anchor", "left_anti").withColumn("_group", F.pmod(F.xxhash64("_anchor"), F.lit(groups)))
    found = small.groupBy("_group").applyInArrow(_stream(window), schema)
    if not large.count():
        out = written(found, "found")
        used_up(large)
        return out
    rest = distinct.join(large_side, "_anchor", "left_semi")
    if cut < CUTS:
        parts = rest.mapInArrow(_recut(window, cut + 1), "_outer long, _whole long, _count long, _from int, _anchor long, _string binary").withColumn("_text", F.xxhash64("_string"))
        parts = written(parts, "parts")
        again = written(parts.groupBy("_anchor", "_text", "_string").agg(F.sum("_count").alias("_count"), F.count("*").alias("_places")), "again")
        below = _found(again.drop("_places"), window, cut + 1)
        inner = _at_places(parts.select("_outer", "_whole", "_from", *_KEYS), below, again, "_places")
        moved = lambda x: F.transform(x, lambda k: k + F.col("_from"))
        inner = inner.select(F.col("_outer").alias("_anchor"), F.col("_whole").alias("_text"), moved("_low").alias("_low"), moved("_high").alias("_high"))
        hits = inner.groupBy("_anchor", "_text").agg(F.collect_list(F.arrays_zip("_low", "_high")).alias("_z")).select("_anchor", "_text", F.flatten("_z").alias("_z")).select("_anchor", "_text", F.col("_z._low").alias("_low"), F.col("_z._high").alias("_high"))
        on_the_way = (large, parts, again, below)
    else:
        single = rest.mapInArrow(_windows(window), "_anchor long, _text long, _count long, _at int, _string binary").withColumn("_window", F.xxhash64("_string"))
        single = written(single, "windows")
        often = written(single.groupBy("_window", "_string").agg(F.sum("_count").alias("_n"), F.count("*").alias("_rows")).filter("_n > 1"), "often")
        hot = F.col("_rows") * HOT_PARTS >= single.count()
        hits = hot_join(single, often, ["_window", "_string"], hot, "left_semi").groupBy("_anchor", "_text").agg(F.collect_set("_at").alias("_low"))
        hits = hits.withColumn("_high", F.transform("_low", lambda x: x + window))
        on_the_way = (large, single, often)
    out = written(found.unionByName(hits), "found")
    used_up(*on_the_way)
    return out


def repeated_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of words (``_low`` to ``_high``, lists in order of neither) that windows found elsewhere cover.

    One row for each distinct (``_id``, ``_hash`` of the text) that has such a window.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).cast("string").alias("_text"))
    lists = written(slim.mapInArrow(_anchors(window), f"_id {kind}, _hash long, _starts array<int>, _anchors array<long>"), "anchors")
    each = lists.select("_id", "_hash", F.explode(F.arrays_zip("_starts", "_anchors")).alias("_z")).select("_id", "_hash", F.col("_z._starts").alias("_start"), F.col("_z._anchors").alias("_anchor"))
    twice = written(each.groupBy("_anchor").agg(F.count("*").alias("_n")).filter("_n > 1"), "twice")
    total = lists.agg(F.sum(F.size("_starts"))).first()[0] or 0
    hot = F.broadcast(twice.filter(F.col("_n") * HOT_PARTS >= total).select("_anchor"))
    cold = twice.filter(F.col("_n") * HOT_PARTS < total).select("_anchor")
    again = each.join(hot, "_anchor", "left_semi").unionByName(each.join(hot, "_anchor", "left_anti").join(cold, "_anchor", "left_semi"))
    wanted = again.groupBy("_id", "_hash").agg(F.collect_set("_start").alias("_wanted"))
    wanted = wanted.select(F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2"), "_wanted")
    # the lists grow with the corpus: they are never broadcast
    some = slim.join(wanted.hint("merge"), same(F.col("_id"), F.col("_id2")) & (F.col("_hash") == F.col("_hash2"))).select("_id", "_hash", "_text", "_wanted")
    cut = some.mapInArrow(_cut(window), f"_id {kind}, _hash long, _start int, _anchor long, _string binary")
    cut = written(cut.withColumn("_text", F.xxhash64("_string")), "segments")
    used_up(lists, twice)
    distinct = written(cut.groupBy("_anchor", "_text", "_string").agg(F.count("*").alias("_count")), "distinct")
    spans = _at_places(cut.select("_id", "_hash", "_start", *_KEYS), _found(distinct, window), distinct, "_count")
    spans = spans.select("_id", "_hash", F.transform("_low", lambda x: x + F.col("_start")).alias("_low"), F.transform("_high", lambda x: x + F.col("_start")).alias("_high"))
    return spans.groupBy("_id", "_hash").agg(F.collect_set(F.struct("_low", "_high")).alias("_spans")).select("_id", "_hash", F.flatten("_spans._low").alias("_low"), F.flatten("_spans._high").alias("_high"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row of ``docs`` without the words that a repeated window covers.

    Words are runs of other characters than space and U+0009 to U+000D.  A window of ``window`` consecutive
    words of a text is repeated if its words, unchanged, also start anywhere else, in the same text too;
    windows are judged on ``docs`` as it is, and all places of a repeated one go.  Null, empty and short texts
    have no window.  Repeated rows are places of their own.  An empty table gives no rows.

    Returns the id, ``n_words``, ``n_removed`` and ``text``: a text from which nothing is taken as it was (null
    stays null), else the words left, joined by one space.  With ``digest``, ``kept_sha256`` of the words left
    joined by one space is in its place.  The columns of ``carry`` come along as they are.
    """
    carried = [F.col(c).alias(f"_carry{k}") for k, c in enumerate(carry)]
    kind = docs.schema[id_col].dataType.simpleString()
    spans = repeated_spans(docs, window, id_col, text_col).select(F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2"), "_low", "_high")
    slim = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).cast("string").alias("_text"), *carried)
    both = slim.join(spans.hint("merge"), same(F.col("_id"), F.col("_id2")) & (F.col("_hash") == F.col("_hash2")), "left").select("_id", "_text", "_low", "_high", *(f"_carry{k}" for k in range(len(carry))))

    def run(batches):
        for b in small_batches(batches):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            sizes, gone, out = [], [], []
            for text, low, high in zip(texts, b.column(2), b.column(3)):
                words = (text or b"").split()
                n = len(words)
                if low.is_valid:
                    drop = np.zeros(n, bool)
                    for a, z in zip(low.as_py(), high.as_py()):
                        drop[a:z] = True
                    words = [w for w, x in zip(words, drop.tolist()) if not x]
                sizes.append(n)
                gone.append(n - len(words))
                if digest:
                    out.append(hashlib.sha256(b" ".join(words)).hexdigest())
                else:
                    out.append(text if n == len(words) else b" ".join(words))
            last = pa.array(out, pa.string()) if digest else pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), last, *b.columns[4:]], ["_id", "n_words", "n_removed", "kept_sha256" if digest else "text", *names])

    names = [f"_carry{k}" for k in range(len(carry))]
    kinds = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, carry))
    got = both.mapInArrow(run, f"_id {kind}, n_words long, n_removed long, " + ("kept_sha256" if digest else "text") + " string" + kinds)
    return got.withColumnsRenamed({"_id": id_col, **dict(zip(names, carry))})
