"""Stores, counts and packing of token ids against plain versions."""

import random
import uuid
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessel.llm.common import shared_dir
from tessel.llm.drr_packing import SEQUENCE, pack, places, plan_rounds
from tessel.llm.linmax import Automaton, automaton, byte_pieces, token_counts
from tessel.llm.repair_store import Shard, compress, read_ids, to_payload, write_ids
from tessel.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "  ", "   ", "a  b", "a   b", " a", "a ", "a  ", "a\n b", "a \nb", "x <|endoftext|> y", "don't  's", "é 　b", "\n \n", "z" * 5000, "word " * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def some_texts(seed, n):
    r = random.Random(seed)
    return ODD + ["".join(r.choice(["the", "re", "'s", "é", "12", " ", " ", " ", "\n", ".", "\t", "<|"]) for _ in range(r.randrange(300))) for _ in range(n)]


def test_encoder(library):
    texts = [x or "" for x in some_texts(0, 400)]
    enc = Encoder(PATH)
    for _ in range(2):
        for text, got in zip(texts, enc.encode_many(texts)):
            assert np.frombuffer(got, enc.type).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_payload():
    r = np.random.default_rng(0)
    for ids in ([], [5], [7] * 1000, r.integers(0, 9, 30_000), r.integers(0, 50257, 3000), np.tile(r.integers(0, 50257, 90), 500)):
        ids = np.array(ids, np.uint32)
        shard = Shard(payload := to_payload(ids, 50257))
        assert (shard.read() == ids).all() and shard.ids == len(ids)
        for _ in range(20):
            a, b = sorted(r.integers(0, len(ids) + 1, 2).tolist())
            assert (shard.read(a, b) == ids[a:b]).all()
    assert len(payload) < 2 * len(ids) / 10


@pytest.mark.parametrize("vocabulary", [50257, 65000, 65536, 100_000, (1 << 24) - 50])
def test_rules_of_any_vocabulary(vocabulary):
    r = np.random.default_rng(1)
    frequent = np.tile(r.integers(0, vocabulary, 90), 500)
    some = np.concatenate([r.integers(0, vocabulary, 200_000), *(np.tile(r.integers(0, vocabulary, 2), 8) for _ in range(30))])
    for ids in (frequent, some):
        shard = Shard(payload := to_payload(ids.astype(np.uint32), vocabulary))
        assert (shard.read() == ids).all() and (shard.read(1500, 2500) == ids[1500:2500]).all()
    assert len(to_payload(frequent.astype(np.uint32), vocabulary)) < 2 * len(frequent) / 10
    # rounds go on where one saves little: no pair is left 8 times or more
    _, _, seq = compress(np.concatenate([r.integers(0, 50257, 30_000), frequent % 50257, *([k, k + 1] * 4 for k in range(0, 400, 2))]).astype(np.uint32), 50257)
    pairs = Counter(zip(seq[:-1].tolist(), seq[1:].tolist()))
    assert max(n for (a, b), n in pairs.items() if a != b) < 8


def test_store(spark, library, monkeypatch):
    import tessel.llm.repair_store as module

    monkeypatch.setattr(module, "SHARD_IDS", 2000)
    texts = some_texts(1, 60)
    data = [(i * 7 % 1000, x) for i, x in enumerate(texts)] + [(3, "again"), (3, "again"), (None, "first")]
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    write_ids(spark.createDataFrame([(*x, 1) for x in data], "doc_id long, text string, part int").repartition(4), path, PATH)
    got = sorted(read_ids(spark, path, digest=True).collect(), key=lambda r: r.start)
    assert {r.start: zlib.crc32(r.ids) for r in read_ids(spark, path).collect()} == {r.start: r.ids_crc32 for r in got}
    assert [r.doc_id for r in got] == sorted((i for i, _ in data), key=lambda i: -1 if i is None else i)
    start = 0
    for r in got:
        want = [np.array([*library.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x in data if i == r.doc_id]
        assert r.start == start and (r.n_tokens, r.ids_crc32) in [(len(w), zlib.crc32(w.tobytes())) for w in want]
        start += r.n_tokens
    empty = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    write_ids(spark.createDataFrame([], "doc_id long, text string"), empty, PATH)
    assert read_ids(spark, empty).count() == 0


def greedy(word, opening, later):
    n, at = 0, 0
    while at < len(word):
        pieces = later if n else opening
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return None
        n, at = n + 1, at + size
    return n


def test_automaton():
    r = random.Random(0)
    for _ in range(150):
        make = lambda: {bytes(r.choice(b"abc") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 12))}
        opening, later = make(), make()
        engine = Automaton(opening, later)
        for _ in range(60):
            word = bytes(r.choice(b"abc") for _ in range(r.randrange(12)))
            assert engine.count(word) == greedy(word, opening, later), (word, opening, later)


def test_token_counts(spark):
    pieces = byte_pieces(PATH)
    opening = {p[1:] for p in pieces if p[:1] == b" " and len(p) > 1} | {bytes([b]) for b in range(256)}
    later = {p for p in pieces if b" " not in p}
    assert automaton(PATH).count(b"thereafter") == greedy(b"thereafter", opening, later)
    data = list(enumerate(some_texts(3, 40)))
    for r in token_counts(spark.createDataFrame([(*x, "y") for x in data], "doc_id long, text string, n_words string"), PATH).collect():
        words = (dict(data)[r.doc_id] or "").encode().split()
        assert (r.n_words, r.n_pieces) == (len(words), sum(greedy(w, opening, later) for w in words))


def test_rounds():
    r = random.Random(0)
    for _ in range(40):
        totals = [r.randrange(1, 3000) for _ in range(r.randrange(1, 7))]
        weights = r.choice([totals, [1.0] * len(totals), [r.random() for _ in totals], [0.0, *[1.0] * (len(totals) - 1)]])
        phases = plan_rounds(totals, weights, 64)
        seen = []
        for i, n in enumerate(totals):
            got = places(phases, i, 0, n)
            assert sum(x[2] for x in got) == n
            part = [x for a in range(0, n, 100) for x in places(phases, i, a, min(100, n - a))]
            flat = lambda runs: {p + j: at + j for p, at, size in runs for j in range(size)}
            assert flat(got) == flat(part)
            seen += flat(got).values()
        assert sorted(seen) == list(range(sum(totals)))


@pytest.mark.parametrize("queues", [128, 2])
def test_pack(spark, library, monkeypatch, queues):
    import tessel.llm.drr_packing as module

    monkeypatch.setattr(module, "MAX_QUEUES", queues)
    texts = some_texts(4, 80)
    data = [(i, x, ["a", "b", None, "c"][i % 4] if i % 3 else "a", 1) for i, x in enumerate(texts)]
    got = pack(spark.createDataFrame(data, "doc_id long, text string, source string, start int").repartition(5), PATH, with_ids=True).collect()
    by = {}
    for p in got:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length and p.length > 0
        by.setdefault(p.doc_id, []).append(p)
    for i, x, source, _ in data:
        want = np.array([*library.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        mine = sorted(by[i], key=lambda p: p.start)
        assert b"".join(p.ids for p in mine) == want and {p.source for p in mine} == {source} and {p.doc_tokens for p in mine} == {len(want) // 4}
        assert [p.start for p in mine] == np.cumsum([0, *(p.length for p in mine)])[:-1].tolist()
    total = sum(p.length for p in got)
    at = sorted((p.sequence_id * SEQUENCE + p.offset, p.length) for p in got)
    assert [a for a, _ in at] == np.cumsum([0, *(n for _, n in at)])[:-1].tolist() and at[-1][0] + at[-1][1] == total
    assert all(p.offset + p.length <= SEQUENCE for p in got)
    assert pack(spark.createDataFrame([], "doc_id long, text string, source string"), PATH).count() == 0


def test_mixture(spark):
    """Every window has the corpus's proportions, but for a token of each source."""
    data = [(i, "word " * 500, "hot" if i % 4 else "cold") for i in range(400)]
    got = pack(spark.createDataFrame(data, "doc_id long, text string, source string"), PATH).collect()
    cold = {}
    for p in got:
        if p.source == "cold":
            cold[p.sequence_id // 16] = cold.get(p.sequence_id // 16, 0) + p.length
    full = [n for w, n in cold.items() if w < max(cold)]
    assert full and max(abs(n - 4096) for n in full) <= 4


def test_mixture_of_many_sources(spark):
    """With more sources than MAX_QUEUES every window still has each source's own proportion."""
    data = [(i, "word " * 900, "hot") for i in range(200)] + [(1000 + i, "word " * 299, f"rare {i % 200}") for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    got = pack(docs, PATH).collect()
    total, have = sum(p.length for p in got), {}
    size, window = {}, 16 * SEQUENCE
    for p in got:
        size[p.source] = size.get(p.source, 0) + p.length
        have[p.source, p.sequence_id // 16] = have.get((p.source, p.sequence_id // 16), 0) + p.length
    assert len(size) == 201
    # windows lose less than an id a source against the rounds; a sequence's end lies that far from a round's
    for s, n in size.items():
        for w in range(total // window - 1):
            assert abs(have.get((s, w), 0) - n * window / total) <= (2 if s != "hot" else 201), (s, w)


def test_weights_of_many_sources(spark):
    """Given targets hold with more sources than MAX_QUEUES; others wait until those are dry."""
    data = [(i, "word " * 900, "a" if i % 2 else "b") for i in range(100)] + [(1000 + i, "word " * 20, f"rare {i}") for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    have = {}
    for p in pack(docs, PATH, weights={"a": 3.0, "b": 1.0}).collect():
        if p.sequence_id < 32:
            have[p.source] = have.get(p.source, 0) + p.length
    assert set(have) == {"a", "b"} and abs(have["a"] - 3 * 8 * SEQUENCE) <= 4, have


def test_rounds_of_many_queues():
    """Against deficits counted round by round, in the phase before the first queue is dry."""
    r = random.Random(5)
    totals = [r.randrange(40, 90) for _ in range(300)]
    weights = [r.choice([0.5, 1.0, 3.0]) for _ in totals]
    plan, mass = plan_rounds(totals, weights, 256), sum(weights)
    deficit, given, want, at = [0] * len(totals), [0] * len(totals), [], 0
    for _ in range(15):
        for i, w in enumerate(weights):
            deficit[i] += int(w / mass * 256 * 65536)
            n, deficit[i] = deficit[i] >> 16, deficit[i] & 65535
            want += [(i, given[i], at, n)] if n else []
            given[i], at = given[i] + n, at + n
    assert all(n < x for n, x in zip(given, totals))
    assert sorted((i, *x) for i, n in enumerate(given) for x in places(plan, i, 0, n)) == sorted(want)
    seen = sorted(x[1:] for i, n in enumerate(totals) for x in places(plan, i, 0, n))
    assert [a for a, _ in seen] == np.cumsum([0, *(n for _, n in seen)])[:-1].tolist() and sum(n for _, n in seen) == sum(totals)
