"""Substring dedup against plain counting of windows."""

import hashlib
import random
import re
from collections import Counter

import pytest

import tessel.llm.suffix_automata as module
from tessel.llm.suffix_automata import Automaton, remove_repeats


def plain(data, k):
    words = [re.findall(r"[^\x20\x09-\x0D]+", x or "") for _, x in data]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (i, _), w in zip(data, words):
        drop = {j for s in range(len(w) - k + 1) if seen[tuple(w[s : s + k])] > 1 for j in range(s, s + k)}
        left = [x for j, x in enumerate(w) if j not in drop]
        out.append((i, len(w), len(drop), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def some_texts(seed, n):
    r = random.Random(seed)
    shared = [[str(r.randrange(500)) for _ in range(r.choice([10, 34, 35, 36, 50, 90]))] for _ in range(12)]
    out = [None, "", " \n ", "a " * 34, "b " * 35, "c " * 36, "d " * 36, "x y " * 200, " ".join(map(str, range(20_000))), "É é " * 80]
    for _ in range(n):
        words = [str(r.randrange(500)) for _ in range(r.choice([0, 3, 40, 120]))]
        for _ in range(r.randrange(4)):
            at = r.randrange(len(words) + 1)
            words[at:at] = r.choice(shared)
        out.append("".join(w + r.choice([" ", "\n", "  "]) for w in words))
    return out + out[-3:]


@pytest.mark.parametrize(("limit", "window"), [((2000, 1 << 25, 2), 35), ((1, 0, 0), 35), ((1, 0, 2), 5), ((2, 1 << 25, 2), 35)])
def test_removed_words(spark, monkeypatch, limit, window):
    monkeypatch.setattr(module, "SHARD_SEGMENTS", limit[0])
    monkeypatch.setattr(module, "CUTS", limit[2])
    monkeypatch.setattr(module, "HOT_PARTS", 1024 if limit[1] else 4)
    monkeypatch.setattr(module, "GROUP_SEGMENTS", 50)
    monkeypatch.setattr("tessel.llm.common.BROADCAST_BYTES", limit[1])
    data = list(enumerate(some_texts(window, 60))) + [(900, "z " * 3 + " ".join(map(str, range(50))))] * 2 + [(None, "q")]
    docs = spark.createDataFrame([(*x, 5, 6) for x in data], "doc_id long, text string, _hash int, n_words int").repartition(5)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs, window, digest=True).collect()), key=repr)
    assert got == plain(data, window)


def test_a_very_common_phrase(spark, monkeypatch):
    """A phrase in very many surroundings is one large shard, which is cut by other anchors."""
    monkeypatch.setattr(module, "SHARD_SEGMENTS", 20)
    r = random.Random(3)
    phrase, other = "all rights are reserved by the owners of this page".split(), [f"o{k}" for k in range(40)]
    data = []
    for i in range(120):
        words = [f"w{r.randrange(10_000)}" for _ in range(60)]
        words[20:30] = phrase
        if i % 3 == 0:
            words[25:25] = other
        data.append((i, " ".join(words)))
    data += [(200 + i, x) for i, x in data[:10]]
    got = sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(4), digest=True).collect()), key=repr)
    assert got == plain(data, 35) and sum(x[2] for x in got) > 2000


def test_texts_stay_as_they_are(spark):
    data = [(1, "a  b\n"), (2, None), (3, "u " + " ".join(map(str, range(40)))), (4, " ".join(map(str, range(40))) + "\nv")]
    got = {r.doc_id: r.text for r in remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: "a  b\n", 2: None, 3: "u", 4: "v"}
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automaton():
    r = random.Random(0)
    for _ in range(200):
        strings = [("".join(r.choice("abc") for _ in range(r.randrange(1, 20))), r.randrange(1, 3)) for _ in range(r.randrange(1, 6))]
        k, automaton = r.randrange(1, 6), Automaton()
        for s, n in strings:
            automaton.add(s, n)
        automaton.finish()
        seen = Counter()
        for s, n in strings:
            for i in range(len(s) - k + 1):
                seen[s[i : i + k]] += n
        for s in [s for s, _ in strings] + ["".join(r.choice("abc") for _ in range(30))]:
            assert automaton.repeated(s, k) == [i for i in range(len(s) - k + 1) if seen[s[i : i + k]] > 1]
