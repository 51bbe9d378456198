"""Token counts by a linear longest-match automaton.

The vocabulary is a trie.  Where a word leaves the trie, greedy longest-match first has a forced move: it
takes some pieces off the front of what it has read and goes on from the node of the rest.  That node (the
failure link) and the number of pieces (the popped count) are precomputed for every node, so that a word is
counted in one pass over its bytes, without backtracking and without building a piece.
"""

from __future__ import annotations

import json
from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import small_batches

#: Words whose counts a worker remembers, at most.
MEMORY = 400_000


def byte_pieces(path: str) -> set[bytes]:
    """The pieces of a byte-level vocabulary file, added tokens left out, as bytes."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    # the printable characters that byte-level vocabularies write for bytes: bytes that print stand for themselves
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    special = {x["content"] for x in said.get("added_tokens", [])}
    return {bytes(code[c] for c in token) for token in said["model"]["vocab"] if token not in special}


class Automaton:
    """Counts the pieces that greedy longest-match-first takes from a word.

    ``opening`` are the pieces that a word can begin with, ``later`` those that can follow.  A word that
    can't be cut so has None.
    """

    def __init__(self, opening: set[bytes], later: set[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]  # 0: the beginning of a word, 1: after a piece
        self.ends = [False, False]
        depth = [0, 0]
        for root, pieces in ((0, opening), (1, later)):
            for piece in pieces:
                if not piece:
                    continue
                at = root
                for b in piece:
                    to = self.next[at].get(b)
                    if to is None:
                        to = len(self.next)
                        self.next[at][b] = to
                        self.next.append({})
                        self.ends.append(False)
                        depth.append(depth[at] + 1)
                    at = to
                self.ends[at] = True
        n = len(self.next)
        self.fail = [-1] * n
        self.popped = [0] * n
        queue = deque([0, 1])
        while queue:
            at = queue.popleft()
            for b, to in self.next[at].items():
                if self.ends[to]:
                    self.fail[to], self.popped[to] = 1, 1
                else:
                    back, popped = self.fail[at], self.popped[at]
                    while back >= 0 and b not in self.next[back]:
                        popped += self.popped[back]
                        back = self.fail[back]
                    if back >= 0:
                        self.fail[to], self.popped[to] = self.next[back][b], popped
                queue.append(to)

    def count(self, word: bytes) -> int | None:
        nxt, fail, popped = self.next, self.fail, self.popped
        at = total = 0
        for b in word:
            while (to := nxt[at].get(b)) is None:
                if fail[at] < 0:
                    return None
                total += popped[at]
                at = fail[at]
            at = to
        while at > 1:
            if fail[at] < 0:
                return None
            total += popped[at]
            at = fail[at]
        return total


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """A file's automaton: a piece that opens a word is one with the mark of a space before it."""
    pieces = byte_pieces(path)
    opening = {p[1:] for p in pieces if p[:1] == b" " and len(p) > 1}
    later = {p for p in pieces if b" " not in p}
    return Automaton(opening | {bytes([b]) for b in range(256)}, later)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row the id, ``n_words`` and ``n_pieces`` (long).

    Words are runs of other characters than space and U+0009 to U+000D, in UTF-8.  ``n_pieces`` is the number
    of pieces that greedy longest-match-first takes from the words: word-opening pieces of ``vocabulary`` (or
    any single byte) first, then its other pieces.  A word that can't be cut counts as one piece.  Null,
    empty and blank texts have zeros.  Only one row's words and MEMORY counts are held at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        engine, known = automaton(vocabulary), {}
        for b in small_batches(batches):
            words, pieces = [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                own = (text or b"").split()
                if len(known) > MEMORY:
                    known.clear()
                for w in set(own).difference(known):
                    known[w] = engine.count(w) or 1
                words.append(len(own))
                pieces.append(sum(map(known.__getitem__, own)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(pieces, pa.int64())], ["_id", "n_words", "n_pieces"])

    got = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"_id {kind}, n_words long, n_pieces long")
    return got.withColumnRenamed("_id", id_col)
