"""Repetition within a text, by a suffix array over its words.

Suffixes of all texts of a batch are sorted together by prefix doubling; the first words' ranks differ
from text to text, so suffixes of two texts never tie.  Longest common prefixes of neighbours are compared only
where they don't follow from those of the place before.  An interval of the array whose common prefix is long
is a maximal repeated substring; the union of the spans of all of them is what the text has more than once.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import small_batches

#: Substrings of fewer words don't count as repeated passages.
MIN_WORDS = 5
#: A text is dropped if more of its words than this fraction lie in repeated passages (words in such passages
#: are also in 3-word windows found twice, so a fraction of the base rule's 0.5 or more would drop nothing) ...
MAX_FRACTION = 0.15
#: ... or if the longest repeated passage has more than this fraction of its words and at least LONG_WORDS.  A
#: passage found twice covers twice its share, so this acts on its own below MAX_FRACTION / 2.
MAX_LONGEST, LONG_WORDS = 0.05, 10
#: Words sorted together; a longer text is sorted alone.
BATCH_WORDS = 200_000

SYMBOLS = b"#*$%&|<>"
_WS = b" \t\n\x0b\x0c\r"


def suffix_array(first: np.ndarray) -> np.ndarray:
    """The suffix array of ``first`` (integers) by prefix doubling.

    Suffixes that no other one ties with aren't sorted again; one array of ranks is all that is kept.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = first[order[1:]] != first[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    places = np.flatnonzero(~(new & np.append(new[1:], True)))  # places of the array that are not settled; ranks are places
    while len(places):
        own = order[places]
        nxt = own + step
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        group = rank[own]
        by = np.lexsort((second, group))
        own, group, second = own[by], group[by], second[by]
        new = np.empty(len(own), bool)
        new[0] = True
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        order[places] = own
        rank[own] = np.maximum.accumulate(np.where(new, places, 0))
        places = places[~(new & np.append(new[1:], True))]
        step *= 2
    return order


def _common(first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of places how many values from there on are equal.

    Pairs are compared together, a few values at a time and then more; those that are very long go one by one.
    """
    n = len(first)
    out = np.zeros(len(a), np.int64)
    live, size = np.arange(len(a)), 4
    while len(live) and size <= 1 << 12:
        rows, left = (1 << 20) // size, []
        for at in range(0, len(live), rows):
            own = live[at : at + rows]
            x, y = (z[own, None] + out[own, None] + np.arange(size) for z in (a, b))
            like = (np.maximum(x, y) < n) & (first[np.minimum(x, n - 1)] == first[np.minimum(y, n - 1)])
            same = np.where(like.all(axis=1), size, like.argmin(axis=1))
            out[own] += same
            left.append(own[same == size])
        live, size = np.concatenate(left), 4 * size
    for k in live.tolist():
        x, y = int(a[k] + out[k]), int(b[k] + out[k])
        while max(x, y) < n:
            some = min(size, n - max(x, y))
            unlike = np.flatnonzero(first[x : x + some] != first[y : y + some])
            same = int(unlike[0]) if len(unlike) else some
            out[k], x, y = out[k] + same, x + same, y + same
            if same < some:
                break
    return out


def neighbour_prefixes(first: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each place but the first, the words that its suffix has in common with the one before.

    Where the words before the two suffixes are equal too, the number is one less than that of the suffix before in
    the text; so only the others are compared.  What is compared grows as n log n at most, what is kept as n.
    """
    n = len(order)
    if n < 2:
        return np.zeros(0, np.int64)
    before = np.full(n, -1)  # of each suffix the one before it in the array
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    follows = (at > 0) & (before > 0)
    follows[follows] = first[at[follows] - 1] == first[before[follows] - 1]
    alone = np.flatnonzero(~follows & (before >= 0))
    found = np.zeros(n, np.int64)
    found[alone] = _common(first, alone, before[alone])
    start = np.maximum.accumulate(np.where(follows, 0, at))
    found = found[start] - (at - start)
    return found[order[1:]]


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places the spans cover."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return np.cumsum(delta[:-1]) > 0


def repeats(texts_words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: words in 3-word windows found twice, words in repeated passages, the longest one's words."""
    sizes = np.array([len(x) for x in texts_words], np.int64)
    total = int(sizes.sum())
    zero = np.zeros(len(sizes), np.int64)
    if not total:
        return zero, zero, zero
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter((numbers[w] for x in texts_words for w in x), np.int64, total)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    keys = doc * len(numbers) + ids
    order = suffix_array(keys)
    shared = neighbour_prefixes(keys, order)
    longest = np.zeros(total, np.int64)  # from each place, the longest passage that is also elsewhere
    longest[order[1:]] = shared
    np.maximum.at(longest, order[:-1], shared)
    starts = np.cumsum(sizes) - sizes
    add = lambda x: np.add.reduceat(np.append(x, 0), np.minimum(starts, total))[: len(sizes)] * (sizes > 0)
    at = np.flatnonzero(longest >= 3)
    three = _covered(at, np.full(len(at), 3), total)
    at = np.flatnonzero(longest >= MIN_WORDS)
    long = _covered(at, longest[at], total)
    most = np.maximum.reduceat(np.append(longest, 0), np.minimum(starts, total))[: len(sizes)]
    most = np.where((sizes > 0) & (most >= MIN_WORDS), most, 0)
    return add(three.astype(np.int64)), add(long.astype(np.int64)), most


FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, longest_repeat long"


def _features(texts: list[bytes]) -> list[np.ndarray]:
    words = [x.split() for x in texts]
    base = []
    for x in texts:
        # code points: bytes that don't continue one, less the separators
        bare = x.translate(None, _WS)
        lines = [line for line in x.split(b"\n") if line.strip()]
        base.append((len(bare.decode("utf-8", "replace")), len(x) - len(x.translate(None, SYMBOLS)), len(lines) - len(set(lines))))
    chars, symbols, dups = np.array(base, np.int64).reshape(len(texts), 3).T
    parts, at = [], 0
    while at < len(words):
        end, size = at, 0
        while end < len(words) and (end == at or size + len(words[end]) <= BATCH_WORDS):
            size += len(words[end])
            end += 1
        parts.append(repeats(words[at:end]))
        at = end
    three, covered, most = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else ((), (), ())))
    return [np.array([len(x) for x in words], np.int64), chars, symbols, dups, three, covered, most]


def repetition_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the counts of ``FEATURES`` for each row.

    Words are runs of other characters than space and U+0009 to U+000D.  A null or empty text has zeros.
    Memory is bounded by a batch of rows and the longest text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def run(batches):
        for b in small_batches(batches):
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in _features(texts))], ["_id", *names])

    got = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"_id {kind}, {FEATURES}")
    return got.withColumnRenamed("_id", id_col)


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``repetition_features`` with ``base_failed`` and ``kept`` for each row.

    A text fails the base rules with fewer than 50 words, or with over half of its words in 3-word windows
    that it has twice.  Of the others, those stay that have at most MAX_FRACTION of their words in repeated
    passages and no repeated passage longer than MAX_LONGEST of the text (fewer than LONG_WORDS words always pass).
    Null, empty and blank texts fail the base rules.
    """
    got = repetition_features(docs, id_col, text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = (F.col("n_covered_words") <= MAX_FRACTION * F.col("n_words")) & ((F.col("longest_repeat") < LONG_WORDS) | (F.col("longest_repeat") <= MAX_LONGEST * F.col("n_words")))
    return got.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)
