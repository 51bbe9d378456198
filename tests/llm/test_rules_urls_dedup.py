"""Repetition rules, URL filter and exact dedup against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessel.llm.bloom_urls import BlockedBloom, judge_urls
from tessel.llm.golomb_dedup import exact_dedup, rice_decode, rice_encode, without_copies
from tessel.llm.suffix_repeats import LONG_WORDS, MAX_FRACTION, MAX_LONGEST, MIN_WORDS, neighbour_prefixes, repetition_rules, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, " \t\n", "a", "a a a a a a a a", "é\u00a0ß x\x1cy", "one\ntwo\none\n\n \none", "#*$%&|<>"]


def texts(seed: int, n: int) -> list:
    r = random.Random(seed)
    out = list(ODD)
    for _ in range(n):
        words = [r.choice(["ab", "cd", "é", "x,", "ff|"]) if r.random() < 0.3 else str(r.randrange(400)) for _ in range(r.randrange(200))]
        if r.random() < 0.5 and words:
            at, size = r.randrange(len(words)), r.randrange(40)
            words += words[at : at + size]
        out.append("".join(w + r.choice([" ", " ", "\n", "  "]) for w in words))
    return out + [out[-1], "w " * 3000, " ".join(map(str, range(30000)))]


def plain_rules(text):
    words = WORD.findall(text or "")
    n = len(words)
    grams = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    three = {j for i in range(n - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    covered, longest, size = set(), 0, MIN_WORDS
    while True:
        seen = Counter(tuple(words[i : i + size]) for i in range(n - size + 1))
        at = [i for i in range(n - size + 1) if seen[tuple(words[i : i + size])] > 1]
        if not at:
            break
        if size == MIN_WORDS:
            covered = {j for i in at for j in range(i, i + size)}
        longest, size = size, size + 1
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(three), len(covered), longest


def test_repetition(spark):
    verdicts = Counter()
    data = [(i, x) for i, x in enumerate(texts(1, 120)) if x is None or len(x) < 5000]
    rows = {r.doc_id: r for r in repetition_rules(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()}
    assert len(rows) == len(data)
    for i, x in data:
        r = rows[i]
        want = plain_rules(x)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_covered_words, r.longest_repeat) == want, x
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        fine = want[5] <= MAX_FRACTION * want[0] and (want[6] < LONG_WORDS or want[6] <= MAX_LONGEST * want[0])
        assert r.base_failed == failed and r.kept == (not failed and fine)
        verdicts[failed, r.kept] += 1
    assert min(verdicts[False, True], verdicts[False, False], verdicts[True, False]) > 5


def test_repetition_of_long_texts(spark):
    same, other = "w " * 3000, " ".join(map(str, range(30000)))
    rows = repetition_rules(spark.createDataFrame([(1, same, "x"), (2, other, "x")], "doc_id long, text string, n_words string")).collect()
    assert [(r.n_covered_words, r.longest_repeat, r.kept) for r in sorted(rows)] == [(3000, 2999, False), (0, 0, True)]


def test_each_repetition_limit_acts_alone(spark):
    w = [f"w{i}" for i in range(1000)]
    some = {
        "clean": w[:200],
        "short passages": w[:200] + w[0:6] + w[300:310] + w[20:26] + w[310:320] + w[40:46],  # 36 of 238 words, at most 6 at once
        "few short passages": w[:200] + w[0:6] + w[300:310] + w[20:26],
        "one long passage": w[:200] + w[0:14],  # 28 of 214 words
        "long passage of a long text": w + w[:14],
        "just below the base rule": w[:200] + w[0:60],  # 120 of 260 words
    }
    rows = {r.doc_id: r for r in repetition_rules(spark.createDataFrame([(k, " ".join(x)) for k, x in some.items()], "doc_id string, text string")).collect()}
    assert not any(r.base_failed for r in rows.values())
    assert {k: (r.n_covered_words, r.longest_repeat) for k, r in rows.items() if not r.kept} == {"short passages": (36, 6), "one long passage": (28, 14), "just below the base rule": (120, 60)}


def test_suffix_array():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 300):
        x = r.integers(0, 3, n)
        order = suffix_array(x)
        assert order.tolist() == sorted(range(n), key=lambda i: x[i:].tolist())
        same = lambda a, b: next((k for k in range(n - max(a, b)) if x[a + k] != x[b + k]), n - max(a, b))
        assert neighbour_prefixes(x, order).tolist() == [same(int(a), int(b)) for a, b in zip(order, order[1:])]


def test_prefixes_of_long_repeats():
    """A text that says the same over and over: prefixes of any length, from arrays of its own length alone."""
    x = np.tile(np.random.default_rng(1).integers(0, 50, 3000), 20)
    order = suffix_array(x)
    got = neighbour_prefixes(x, order)
    assert got.max() == 57_000
    for k in range(0, len(got), 997):
        a, b = int(order[k]), int(order[k + 1])
        n = int(got[k])
        assert (x[a : a + n] == x[b : b + n]).all() and (max(a, b) + n == len(x) or x[a + n] != x[b + n])


def test_rice():
    r = np.random.default_rng(0)
    for n, width in ((0, 20), (1, 20), (1000, 20), (5000, 40), (256, 8)):
        x = np.unique(r.integers(0, 1 << width, n)) if n < 1 << width else np.arange(n)
        assert rice_decode(rice_encode(x, width)).tolist() == x.tolist()


def test_filter_has_all_keys():
    h = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 4000)
    bloom = BlockedBloom.of(h[:2000], BlockedBloom.blocks_for(2000))
    assert bloom.may_have(h[:2000]).all() and bloom.may_have(h[2000:]).mean() < 0.02


URLS = [None, "", "no scheme", "http://COM/", "http://a.b.com/x?y", "https://EXAMPLE.com/en/1#t", "x://www.example.com/en/", "http://m.www.example.com/en/a", "http://notexample.com/en/1", "http://a.net/es", "http://a.net/es/", "http://net/fr/?", "http://user@h.net:80/es/", "http://?q=://com/", "http://..com/", "http://a.com"]


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_urls(spark, monkeypatch, limit):
    import tessel.llm.bloom_urls as module

    monkeypatch.setattr(module, "BROADCAST_BYTES", limit)
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("com", "/", "block")][:5]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, u in enumerate(URLS + URLS[:3]):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        assert got[i] == (host, path, best[1], best[2]), u
    urls = spark.createDataFrame([("https://a.net:443/es?b=2&utm_x=1&a=1", "block"), ("http://a.com/", "block"), ("y://USER@h.net/es/", "block"), (None, "block"), ("no scheme", "block")], "url string, verdict string")
    more = [(100 + i, u, "h") for i, u in enumerate(["http://a.net/es?a=1&b=2#t", "http://A.net/es/?a=1&b=2", "http://a.net/es?a=1", "x://user@h.net/es", "http://a.com", "http://spam.org/x/?ref=1"])]
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(more, "page_id long, url string, host string"), spark.createDataFrame(rules, "host string, path string, verdict string"), urls=urls).collect()}
    assert got == {100: (None, "block"), 101: ("net/es/", "block"), 102: (None, "allow"), 103: (None, "block"), 104: (None, "block"), 105: (None, "allow")}
    hot = judge_urls(pages.select("page_id", "url").crossJoin(spark.range(50)), spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert hot.count() == 50 * pages.count()
    none = judge_urls(pages, spark.createDataFrame([], "host string, path string, verdict string")).collect()
    assert len(none) == len(URLS) + 3 and {r.verdict for r in none} == {"allow"}
    assert judge_urls(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


@pytest.mark.parametrize("hot_parts", [256, 1])
def test_exact_dedup(spark, monkeypatch, hot_parts):
    import tessel.llm.golomb_dedup as module

    monkeypatch.setattr(module, "HOT_PARTS", hot_parts)
    data = list(enumerate(texts(2, 40)))
    data += [(100 + i, (x or "").replace(" ", "\n ")) for i, x in data[:30]] + [(300 + i, "hot text") for i in range(50)] + [(None, "alone"), (400, "again"), (400, "again")]
    got = exact_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS _row", "2 AS kept")).collect()
    groups = {}
    for i, x in data:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", x or ""), []).append((-len(x or ""), i))
    want = []
    for key, members in groups.items():
        keep = min(members, key=lambda m: (m[0], -1 if m[1] is None else m[1]))[1]
        want += [(i, keep, len(members), hashlib.sha256(key.encode()).hexdigest()) for _, i in members]
    assert sorted(map(repr, ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got))) == sorted(map(repr, want))
    assert sum(r.kept for r in got) == len(groups) and all(r.kept <= (r.doc_id == r.keep_id) for r in got)
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copies_go_whatever_the_columns_are_called(spark):
    data = [(1, "a b", "x"), (2, "ab", "y"), (None, " a b", "z"), (3, "c", "w"), (3, "c", "w"), (4, None, "v")]
    docs = spark.createDataFrame([(*x, 1, 2, 3) for x in data], "doc_id long, text string, _id string, _own int, _rank int, kept int")
    left = without_copies(docs)
    assert left.columns == docs.columns and sorted(((r.doc_id, r.text, r._id, r._own, r._rank, r.kept) for r in left.collect()), key=str) == sorted([(None, " a b", "z", 1, 2, 3), (3, "c", "w", 1, 2, 3), (4, None, "v", 1, 2, 3)], key=str)
