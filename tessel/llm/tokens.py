"""Ids of whole texts by a tokenizer file of the tokenizers library."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

from tessel.llm.common import KEPT

#: Chunks whose ids a worker remembers, at most, and the slots of its table (a power of two, 20 bytes each).
MEMORY, SLOTS = 1_200_000, 1 << 21
#: Bytes of a chunk that is remembered, at most; and bytes of text that are looked up together, about.
LONGEST, SLICE = 512, 1 << 18

#: White space, a space, then white space or the end: only there can a pre-token of byte-level BPE reach
#: over the place before a space.
_JOINED = re.compile(r"\s (?:\s|\Z)")
_LETTERS = re.compile(r"[^\W\d_]*")

# Byte-level vocabularies write each byte as one printable character (fixed values of the format).
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_MARKS = {b: chr(b) for b in _OWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _OWN)}


_BLANK = np.array([chr(b).isspace() and b < 128 for b in range(256)])


class _Hashes:
    """Two 64-bit hashes of many parts of a buffer at once.

    A part's hash is the sum of its bytes (plus one) times random keys, one for each place, modulo 2 ** 64, with its
    length.  Keys are drawn anew in each worker, so no text can be made to collide: two different parts have the
    same two hashes with probability 2 ** -112 at most, whatever they are.
    """

    def __init__(self):
        self.keys = np.frombuffer(os.urandom(16 * (LONGEST + 1)), np.uint64).reshape(2, LONGEST + 1)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``starts`` and ``ends`` of parts of LONGEST bytes at most that follow one another through all of ``data``."""
        sizes = ends - starts
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        wide = data.astype(np.uint64) + np.uint64(1)
        one, two = (self._mixed(np.add.reduceat(np.take(k, place, mode="clip") * wide, starts) + k[LONGEST] * sizes.astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64) for k in self.keys)
        return one, two

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        return np.maximum(x, np.uint64(1))


class _Memory:
    """Ids of chunks by two 64-bit hashes: open addressing, looked up and filled in bulk."""

    def __init__(self, kind: np.dtype):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.one, self.two = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.entry = np.zeros(SLOTS, np.int32)
        self.offsets, self.pool, self.n = np.zeros(1024, np.int64), np.zeros(1024, self.kind), 0

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Entries, -1 for those that are not there."""
        slot = (one & np.uint64(SLOTS - 1)).astype(np.int64)
        there = self.one[slot]
        out = np.where((there == one) & (self.two[slot] == two), self.entry[slot], -1)
        left = np.flatnonzero((out < 0) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
            own = slot[left]
            there = self.one[own]
            hit = (there == one[left]) & (self.two[own] == two[left])
            out[left[hit]] = self.entry[own[hit]]
            left = left[~hit & (there != 0)]
        return out

    def add(self, one: np.ndarray, two: np.ndarray, ids: list[bytes]) -> None:
        """Distinct chunks that are not there."""
        flat = np.frombuffer(b"".join(ids), self.kind)
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize)
        begin = int(self.offsets[self.n])
        if self.n + len(ids) + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros(max(len(self.offsets), len(ids) + 1), np.int64)])
        if begin + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), self.kind)])
        self.pool[begin : begin + len(flat)] = flat
        self.offsets[self.n + 1 : self.n + 1 + len(ids)] = begin + ends
        slot, left = (one & np.uint64(SLOTS - 1)).astype(np.int64), np.arange(len(ids))
        while len(left):
            free = np.flatnonzero(self.one[slot[left]] == 0)
            own, first = np.unique(slot[left[free]], return_index=True)  # of those that meet one goes in
            put = left[free[first]]
            self.one[own], self.two[own], self.entry[own] = one[put], two[put], self.n + put
            rest = np.ones(len(left), bool)
            rest[free[first]] = False
            left = left[rest]
            slot[left] = (slot[left] + 1) & (SLOTS - 1)
        self.n += len(ids)

    def ids(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries one after the other, and where each ends."""
        starts = self.offsets[entries]
        sizes = self.offsets[entries + 1] - starts
        ends = np.cumsum(sizes)
        return self.pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


class Encoder:
    """Ids as the library gives them with add_special_tokens=False, truncation and padding off.

    With plain byte-level BPE a pre-token never reaches over the place before a single space, so a text's
    ids are those of its chunks, each a space and what follows it.  The library encodes a chunk that is new;
    a memory of bounded size keeps its ids.  Texts with runs of white space around a space, with the string
    of an added token or with a chunk of over LONGEST bytes, and any text under other pre-tokenizers, go to
    the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs as many workers as there are cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.type = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.strings = [""] * self.size
        for token, i in vocabulary.items():
            self.strings[i] = token
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        before = said.get("pre_tokenizer") or {}
        self.chunked = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not said.get("normalizer")
        self.opens = np.array([x.startswith("Ġ") for x in self.strings])
        # pieces with a space after another character are there for no-break spaces alone
        self.direct = self.chunked and all("\u00c2\u0142" in x for x in self.strings if "Ġ" in x.lstrip("Ġ"))
        self.rests: dict[str, bytes] = {}
        self.memory = _Memory(self.type) if self.chunked else None
        self.hashes = _Hashes()

    def whole(self, text: str) -> bytes:
        """A text's ids by the library alone."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _letters(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters only that follow a space: such a word is one pre-token.

        The model takes several in one call.  No piece reaches from a letter over a space, so the pieces that
        open with one are where words begin.
        """
        marks = (" " + " ".join(words)).encode().decode("latin-1").translate(_MARKS).split(_MARKS[32])[1:]
        out: list[bytes] = []
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            end = at + len(some)
            found = [t.id for k in range(at, end, 8) for t in self.tokenizer.model.tokenize(_MARKS[32] + _MARKS[32].join(marks[k : min(k + 8, end)]))]
            out += self._parts(some, np.array(found, self.type))
        return out

    def _heads(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words of letters that chunks begin with: most were chunks before and are remembered."""
        if not words:
            return {}
        data = np.frombuffer((" " + " ".join(words)).encode(), np.uint8)
        starts = np.flatnonzero(data == 32)
        one, two = self.hashes.of(data, starts, np.append(starts[1:], len(data)))
        entries = self.memory.find(one, two)
        new = np.flatnonzero(entries < 0)
        some = [words[k] for k in new.tolist()]
        ids = self._letters(some)
        out = dict(zip(some, ids))
        self.memory.add(one[new], two[new], ids)
        old = np.flatnonzero(entries >= 0)
        flat, ends = self.memory.ids(entries[old])
        blob, cuts = flat.tobytes(), [0, *(ends * self.type.itemsize).tolist()]
        out.update((words[k], blob[a:b]) for k, a, b in zip(old.tolist(), cuts, cuts[1:]))
        return out

    def _parts(self, chunks: list[str], ids: np.ndarray) -> list[bytes]:
        """The ids of each chunk, from those of all chunks with a space before each."""
        cuts = np.flatnonzero(self.opens[ids])
        if len(cuts) != len(chunks):
            return [self.whole(" " + c) for c in chunks]
        data, width = ids.tobytes(), self.type.itemsize
        ends = [*(cuts[1:] * width).tolist(), len(data)]
        return [data[a:b] for a, b in zip((cuts * width).tolist(), ends)]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of chunks that follow a space, by the chunk without it.

        After a run of letters a pre-token ends, whatever follows; so a chunk that begins with letters has the
        ids of these and those of the rest, which is rarely new.
        """
        out: dict[str, bytes] = {}
        alone, heads, both, plain = [], set(), [], []
        for c in chunks:
            if self.direct:
                if c.isalpha():
                    alone.append(c)
                    continue
                n = _LETTERS.match(c).end()
                head = c[:n]
                if head.isalpha():
                    heads.add(head)
                    both.append((c, head, c[n:]))
                    continue
            if c and not c[0].isspace() and not c[-1].isspace():
                plain.append(c)
            else:
                out[c] = self.whole(" " + c)
        out.update(zip(alone, self._letters(alone)))
        out.update(self._heads([x for x in heads if x not in out]))
        if len(self.rests) > MEMORY // 10:
            self.rests = {}
        rests = list({rest for _, _, rest in both}.difference(self.rests))
        for at in range(0, len(rests), 4096):
            some = rests[at : at + 4096]
            self.rests.update(zip(some, (np.array(x.ids, self.type).tobytes() for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False))))
        out.update((c, out[head] + self.rests[rest]) for c, head, rest in both)
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            ids = self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids
            out.update(zip(some, self._parts(some, np.array(ids, self.type))))
        return out

    def _slice(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts that are those of their chunks."""
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        opens = data == 32
        # a space between white space, or between white space and the end: beyond ASCII it was looked for before
        blank = _BLANK[data]
        after = np.append(blank[1:], True)
        after[ends[ends > 0] - 1] = True
        joined_up = np.flatnonzero(opens[1:] & blank[:-1] & after[1:]) + 1
        if len(joined_up):
            owner = np.searchsorted(ends, joined_up, "right")
            inside = joined_up - 1 >= np.append(0, ends)[owner]
            whole = set(owner[inside].tolist())
            if whole:
                rest = iter(self._slice([x for k, x in enumerate(texts) if k not in whole]))
                return [self.whole(x.decode()) if k in whole else next(rest) for k, x in enumerate(texts)]
        begins = (ends - np.fromiter(map(len, texts), np.int64, len(texts)))[[len(x) > 0 for x in texts]]
        opens[begins] = True
        starts = np.flatnonzero(opens)
        stops = np.append(starts[1:], len(data)) if len(starts) else starts
        if len(starts) and int((stops - starts).max()) > LONGEST:
            if len(texts) == 1:
                return [self.whole(joined.decode())]
            return self._slice(texts[: len(texts) // 2]) + self._slice(texts[len(texts) // 2 :])
        one, two = self.hashes.of(data, starts, stops)
        if self.memory.n > MEMORY:
            self.memory.clear()
        entries = self.memory.find(one, two)
        missing = np.flatnonzero(entries < 0)
        if len(missing):
            _, first = np.unique(one[missing], return_index=True)
            new = missing[first]
            spaced = data[starts[new]] == 32
            after, others = new[spaced], new[~spaced]
            chunks = [joined[a:b].decode() for a, b in zip((starts[after] + 1).tolist(), stops[after].tolist())]
            found = self._learn(chunks)
            ids = [found[c] for c in chunks] + [self.whole(joined[a:b].decode()) for a, b in zip(starts[others].tolist(), stops[others].tolist())]
            new = np.concatenate([after, others])
            self.memory.add(one[new], two[new], ids)
            entries[missing] = self.memory.find(one[missing], two[missing])
            if (entries < 0).any():  # two chunks of one first hash
                return [self.whole(x.decode()) for x in texts]
        ids, cuts = self.memory.ids(entries)
        width = self.type.itemsize
        at = np.append(0, cuts)[np.append(0, np.searchsorted(starts, ends))] * width
        blob = ids.tobytes()
        return [blob[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian, in ``self.type``."""
        out: list[bytes] = [b""] * len(texts)
        own: list[int] = []
        held: list[bytes] = []
        size = 0

        def flush():
            nonlocal own, held, size
            for k, ids in zip(own, self._slice(held)):
                out[k] = ids
            own, held, size = [], [], 0

        for k, text in enumerate(texts):
            if not self.chunked or (not text.isascii() and _JOINED.search(text)) or any(x in text for x in self.added):
                out[k] = self.whole(text)
            elif text:
                data = text.encode()
                if held and size + len(data) > SLICE:
                    flush()
                own.append(k)
                held.append(data)
                size += len(data)
        if held:
            flush()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a file."""
    return Encoder(path)


KEPT.append(encoder.cache_clear)


def batches_of_texts(texts, chars: int = 4_000_000):
    """Slices of a list of texts, of about so many characters each."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= chars):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end
