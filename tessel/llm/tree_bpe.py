"""Byte-level BPE encoding by tree concatenation, and decoding.

A pre-token that is long and has no split is cut in halves down to leaves.  Leaves are encoded on their own;
going up the tree two neighbours are joined by re-encoding a window around the join, the last w ids of the
left and the first w of the right.  If the window's ids begin with the left's own first id there and end with
the right's own last one, every pair of neighbouring ids is one that BPE leaves as it is, and a sequence of
such pairs is the only one that BPE gives: the join is exact.  Else w doubles.

A long text's pieces are rows of their own, encoded by any task and joined where they meet.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import small_batches
from tessel.llm.tokens import Encoder, batches_of_texts, encoder

#: A pre-token of more bytes is encoded as a tree, with leaves of at most so many.
LEAF = 512
#: A text of more characters is dealt out in sections of about SECTION characters.
LONG_TEXT, SECTION = 40_000, 16_000

#: The pre-tokens of byte-level BPE (a fixed value of the tokenizer file's format).
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_NO_SPLIT = regex.compile(r"\S{%d}|\s{%d}" % (LEAF // 4, LEAF // 4))
_SAFE = regex.compile(r"(?<=\S) (?=\S)")

# Byte-level vocabularies write each byte as one printable character (fixed values of the format).
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHARS = {b: chr(b) for b in _OWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _OWN)}
_BYTES = {c: b for b, c in _CHARS.items()}


def written_bytes(data: bytes) -> str:
    return "".join(map(_CHARS.__getitem__, data))


class TreeEncoder:
    """Trees over an ``Encoder``'s model, and decoding with its vocabulary."""

    def __init__(self, enc: Encoder):
        self.enc = enc
        self.model = enc.tokenizer.model
        added = set(enc.added)
        self.bytes = [t.encode() if t in added else bytes(_BYTES[c] for c in t) if all(c in _BYTES for c in t) else t.encode() for t in enc.strings]

    def _direct(self, marks: str) -> list[int]:
        return [t.id for t in self.model.tokenize(marks)] if marks else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbouring parts of one pre-token, from the ids of each."""
        if not left or not right:
            return left + right
        w = 2
        while True:
            a, b = min(w, len(left)), min(w, len(right))
            again = self._direct("".join(self.enc.strings[i] for i in left[-a:] + right[:b]))
            if (a == len(left) or again[0] == left[-a]) and (b == len(right) or again[-1] == right[b - 1]):
                return left[:-a] + again + right[b:]
            w *= 2

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """The ids of neighbouring parts of one pre-token, joined in pairs up the tree."""
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def leaves(self, marks: str) -> list[str]:
        """Halves of halves of a pre-token, none longer than a leaf."""
        if len(marks) <= LEAF:
            return [marks]
        half = len(marks) // 2
        return self.leaves(marks[:half]) + self.leaves(marks[half:])

    def tree(self, marks: str) -> list[int]:
        return self.join_all([self._direct(x) for x in self.leaves(marks)])

    def plain(self, text: str) -> bool:
        """Whether the text has no long pre-token, so that the encoder takes it as it is."""
        return not self.enc.chunked or _NO_SPLIT.search(text) is None or any(x in text for x in self.enc.added)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, little-endian in the encoder's type."""
        plain = [k for k, x in enumerate(texts) if self.plain(x)]
        out: list[bytes] = [b""] * len(texts)
        for k, ids in zip(plain, self.enc.encode_many([texts[k] for k in plain])):
            out[k] = ids
        for k in set(range(len(texts))).difference(plain):
            out[k] = b"".join(self.part(*x) for x in cut_pre_tokens(texts[k], SECTION))
        return out

    def part(self, kind: str, part: str) -> bytes:
        """The ids of a part of ``cut_pre_tokens``."""
        if kind == "run":
            return self.enc.encode_many([part])[0]
        return np.array(self.tree(written_bytes(part.encode())), self.enc.type).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def cut_pre_tokens(text: str, size: int):
    """(kind, part) of a text: runs of pre-tokens of about ``size`` characters, and single pre-tokens.

    A run is cut before a space between other characters, or before a long pre-token, which stands alone.
    White space that ends a run there would be one pre-token without what follows it, so it stands alone too.
    The pre-tokens of the runs are then those of the text.
    """
    start = solid = 0  # of the run; the end of its last pre-token that isn't white space
    blanks: list[str] = []  # white space since then
    for m in PRE_TOKEN.finditer(text):
        long = m.end() - m.start() > LEAF // 4
        if long:
            if solid > start:
                yield "run", text[start:solid]
            for x in blanks:
                yield "one", x
            yield "one", m.group()
            start, solid, blanks = m.end(), m.end(), []
            continue
        if m.start() - start >= size and _SAFE.match(text, m.start()):
            yield "run", text[start : m.start()]
            start, solid, blanks = m.start(), m.start(), []
        if m.group().isspace():
            blanks.append(m.group())
        else:
            solid, blanks = m.end(), []
    if start < len(text):
        yield "run", text[start:]


def tree_encoder(path: str) -> TreeEncoder:
    enc = encoder(path)
    if not hasattr(enc, "tree"):
        enc.tree = TreeEncoder(enc)
    return enc.tree


def _digested(ids: bytes, kind: np.dtype, tree: TreeEncoder) -> tuple[int, str, str]:
    numbers = np.frombuffer(ids, kind)
    return len(numbers), hashlib.sha256(numbers.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(tree.decode(numbers).encode()).hexdigest()


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Each row's text encoded, and the ids decoded again.

    Returns the id, ``n_tokens``, ``ids`` (u32, little-endian) and ``decoded``; with ``digests`` the SHA-256 of
    these two (``ids_sha256``, ``decoded_sha256``) in their place.  Null texts count as empty.  Rows are
    independent, repeated ones too.  A task holds a batch of short texts, or one text longer than LONG_TEXT.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    schema = f"_id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string")

    def result(ids: bytes, tree: TreeEncoder) -> tuple:
        if digests:
            return _digested(ids, tree.enc.type, tree)
        numbers = np.frombuffer(ids, tree.enc.type)
        return len(numbers), numbers.astype("<u4").tobytes(), tree.decode(numbers)

    def batch(id_array: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        a, b, c = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([id_array, pa.array(a, pa.int64()), pa.array(b, pa.string() if digests else pa.binary()), pa.array(c, pa.string())], ["_id", *names])

    def short(batches):
        tree = tree_encoder(tokenizer)
        for b in small_batches(batches, keep=True):
            texts = b.column(1).to_pylist()
            for x, y in batches_of_texts(texts):
                yield batch(b.column(0).slice(x, y - x), [result(ids, tree) for ids in tree.encode_many(texts[x:y])])

    def cut(batches):
        """Rows of parts: a run of pre-tokens, or a leaf of a long one (kept together by ``_whole``)."""
        tree = tree_encoder(tokenizer)
        for b in small_batches(batches, keep=True):
            for k, text in enumerate(b.column(2).to_pylist()):
                if not tree.enc.chunked or any(x in text for x in tree.enc.added):
                    parts = [(0, "run", text)]
                else:
                    parts = []
                    for whole, (what, part) in enumerate(cut_pre_tokens(text, SECTION)):
                        if what == "run":
                            parts.append((whole, what, part))
                        else:
                            marks = written_bytes(part.encode())
                            parts += [(whole, "leaf", marks[a : a + SECTION]) for a in range(0, len(marks), SECTION)]
                n = len(parts)
                take = pa.array([k] * n, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(range(n), pa.int32()), *(pa.array(x, t) for x, t in zip(zip(*parts), (pa.int32(), pa.string(), pa.string())))], ["_id", "_hash", "_at", "_whole", "_kind", "_part"])

    def leaves(batches):
        tree = tree_encoder(tokenizer)
        for b in small_batches(batches, keep=True):
            ids = []
            for what, part in zip(b.column("_kind").to_pylist(), b.column("_part").to_pylist()):
                ids.append(tree.enc.encode_many([part])[0] if what == "run" else np.array(tree.tree(part), tree.enc.type).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("_id", "_hash", "_at", "_whole")), pa.array(ids, pa.binary())], ["_id", "_hash", "_at", "_whole", "_ids"])

    def meet(rows: pa.Table) -> pa.Table:
        """Joins the parts of a text; rows with the same id and text are the same, as many as have part 0."""
        tree = tree_encoder(tokenizer)
        at = rows.column("_at").to_pylist()
        parts = dict(zip(at, zip(rows.column("_whole").to_pylist(), rows.column("_ids").to_pylist())))
        wholes: dict[int, list[bytes]] = {}
        for k in sorted(parts):
            wholes.setdefault(parts[k][0], []).append(parts[k][1])
        ids = [x[0] if len(x) == 1 else np.array(tree.join_all([np.frombuffer(y, tree.enc.type).tolist() for y in x]), tree.enc.type).tobytes() for x in wholes.values()]
        n = at.count(0)
        return pa.Table.from_batches([batch(rows.column("_id").combine_chunks().slice(0, 1).take(pa.array([0] * n, pa.int64())), list(repeat(result(b"".join(ids), tree), n)))])

    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    is_long = F.char_length("_text") > LONG_TEXT
    few = slim.filter(~is_long).mapInArrow(short, schema)
    rows = slim.filter(is_long).select("_id", F.xxhash64("_text").alias("_hash"), "_text")
    parts = rows.mapInArrow(cut, f"_id {kind}, _hash long, _at int, _whole int, _kind string, _part string")
    done = parts.repartition("_id", "_hash", "_at").mapInArrow(leaves, f"_id {kind}, _hash long, _at int, _whole int, _ids binary")
    many = done.groupBy("_id", "_hash").applyInArrow(meet, schema)
    return few.unionByName(many).withColumnRenamed("_id", id_col)
