"""Language proportions: held-out accuracy and mixtures."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

import tessel.llm.lang_mixture as module
from tessel.llm.lang_mixture import Models, fit, held_out, mixtures, predict, trigrams, with_main_language, words_of

SF = "/root/testdata/sf0.01/documents.parquet"


def test_trigrams():
    bucket, word = trigrams(["ab", "1", "é", "ab"])
    assert word.tolist() == [0, 0, 2, 3, 3] and bucket[:2].tolist() == bucket[3:].tolist()
    assert words_of("A " + "x" * 70) == ["a", "x" * 32, "x" * 32, "x" * 6]


def test_mixture_of_two():
    r = np.random.default_rng(0)
    logs = np.where(r.random((300, 1)) < 0.7, [[0.0, -6.0, -6.0]], [[-6.0, 0.0, -6.0]])
    first = (logs[:, 0] == 0).mean()
    got = mixtures(np.concatenate([logs, np.zeros((4, 3)), [[-6.0, -6.0, 0.0]] * 9]), np.array([300, 4, 9]))
    assert np.allclose(got[0], [first, 1 - first, 0], atol=0.01) and got[1].tolist() == [1, 0, 0] and got[2].tolist() == [0, 0, 1]


def test_accuracy(spark):
    docs = spark.read.parquet(SF)
    models = fit(docs, ~held_out())
    assert models.languages == ["de", "en", "es", "fr"]
    got = predict(docs, models).join(docs.select("doc_id", "lang"), "doc_id").withColumn("held", held_out()).toPandas()
    assert (got.held == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = got[got.held]
    assert (held.lang == held.lang_pred).mean() >= 0.98 and got.score.between(0, 1).all() and len(got) == docs.count()
    half = [(i, f"{a} {b}") for i, a, b in docs.filter("lang = 'de' AND n_chars BETWEEN 900 AND 1900").limit(8).alias("a").join(docs.filter("lang = 'fr' AND n_chars BETWEEN 900 AND 1900").limit(8).alias("b"), F.lit(True)).selectExpr("a.doc_id", "a.text", "b.text").collect()]
    mixed = predict(spark.createDataFrame(half, "doc_id long, text string"), models).collect()
    assert np.mean([set(r.languages) == {"de", "fr"} for r in mixed]) >= 0.8


def plain_mixture(text, models):
    """Proportions of one text, word by word."""
    k, words = len(models.languages), words_of(text)
    likely = []
    for w in words:
        marks = "\n" + w + "\n"
        sums = [0.0] * k
        for a, b, c in zip(marks, marks[1:], marks[2:]):
            if b.isascii() and not b.isalpha():
                continue
            key = (ord(a) * 0x9E3779B1 + ord(b)) * 0x85EBCA77 + ord(c)
            bucket = ((key * 0x9E3779B97F4A7C15) % (1 << 64) >> 48) % (1 << 16)
            sums = [x + models.logs[bucket, j] for j, x in enumerate(sums)]
        likely.append([max(x - max(sums), -module.SPREAD) for x in sums])
    n, fine = len(words), module.PENALTY * math.log(len(words) + 1)
    alone = [sum(x[j] for x in likely) for j in range(k)]
    best = max(range(k), key=alone.__getitem__)
    if alone[best] >= -fine:
        return {models.languages[best]: 1.0}

    def em(weights):
        for _ in range(module.STEPS):
            new = [0.0] * k
            for x in likely:
                joint = [w * math.exp(y) for w, y in zip(weights, x)]
                new = [a + b / sum(joint) for a, b in zip(new, joint)]
            weights = [x / n for x in new]
        return weights, sum(math.log(sum(w * math.exp(y) for w, y in zip(weights, x))) for x in likely)

    weights, value = em([1 / k] * k)
    live = set(range(k))
    while len(live) > 1:
        less = min(sorted(live), key=lambda j: weights[j])
        begin = [weights[j] + 1e-3 if j in live and j != less else 0.0 for j in range(k)]
        tried, got = em([x / sum(begin) for x in begin])
        if got < value - fine:
            break
        live.discard(less)
        weights, value = tried, got
    return {models.languages[j]: w for j, w in enumerate(weights) if w > 1e-6}


def test_mixtures_of_texts(spark):
    """Texts of one, two and four languages against the same sums in plain loops."""
    docs = spark.read.parquet(SF)
    models = fit(docs, ~held_out())
    some = {lang: [r.text for r in docs.filter((F.col("lang") == lang) & F.col("n_chars").between(150, 700)).orderBy("doc_id").limit(12).collect()] for lang in models.languages}
    texts = [x for xs in some.values() for x in xs[:4]] + [f"{a} {b}" for a, b in zip(some["de"], some["fr"])] + [" ".join(x) for x in zip(*some.values())] + ["a", "xqzj wvk", "12 und 13", "der the le la", "ﬀ 漢字 " * 4]
    got = {r.doc_id: r for r in predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), models).collect()}
    sizes = set()
    for i, x in enumerate(texts):
        want = plain_mixture(x, models)
        sizes.add(len(want))
        assert set(got[i].languages) == set(want) and all(abs(got[i].languages[k] - w) < 1e-6 for k, w in want.items()), x
        assert got[i].lang_pred == max(sorted(want), key=want.get) and abs(got[i].score - max(want.values())) < 1e-6
    assert {1, 2} <= sizes and max(sizes) > 2


def test_sure(spark):
    """The mean of the words' probabilities in plain loops; texts that could be of several languages are less sure."""
    docs = spark.read.parquet(SF)
    models = fit(docs, ~held_out())
    some = {lang: [r.text for r in docs.filter((F.col("lang") == lang) & F.col("n_chars").between(150, 700)).orderBy("doc_id").limit(3).collect()] for lang in models.languages}
    texts = [x for xs in some.values() for x in xs] + [f"{a} {b}" for a, b in zip(some["de"], some["fr"])] + ["a", "xqzj wvk", "12", None]
    got = {r.doc_id: r for r in predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), models).collect()}
    for i, x in enumerate(texts):
        if got[i].lang_pred == "und":
            assert got[i].sure == 0
            continue
        at, chances = models.languages.index(got[i].lang_pred), []
        for w in words_of(x):
            likely = [math.exp(v) for v in models.of_words([w])[0]]
            chances.append(likely[at] / sum(likely))
        assert abs(got[i].sure - sum(chances) / len(chances)) < 1e-9 and 0 < got[i].sure <= 1
    alone, both = [got[i].sure for i in range(12)], [got[i].sure for i in range(12, 15)]
    assert min(alone) > max(both) and len({round(x, 9) for x in alone}) > 6


def test_main_language(spark):
    """Texts of which no language has the share go, whatever other columns they have."""
    docs = spark.read.parquet(SF)
    models = fit(docs, ~held_out())
    some = {lang: [r.text for r in docs.filter((F.col("lang") == lang) & F.col("n_chars").between(900, 1900)).orderBy("doc_id").limit(6).collect()] for lang in models.languages}
    part = lambda x, a, b: " ".join(x.split()[a:b])
    four = [" ".join(part(some[lang][k], 0, 60) for lang in some) for k in range(4)]
    most = [" ".join([part(some["de"][k], 0, 90), part(some["fr"][k], 0, 50)]) for k in range(4)]
    rows = [(k, x, 1) for k, x in enumerate(four)] + [(10 + k, x, 1) for k, x in enumerate(most)] + [(20, None, 1), (21, "12 -", 1), (22, some["es"][0], 1)]
    kept = with_main_language(spark.createDataFrame(rows, "doc_id long, text string, _id int"), models, 0.4)
    want = {i for i, x, _ in rows if x and any(c.isalpha() for c in x) and max(plain_mixture(x, models).values()) >= 0.4}
    assert {r.doc_id for r in kept.collect()} == want and want == {10, 11, 12, 13, 22} and kept.columns == ["doc_id", "text", "_id"]


def test_odd_rows(spark):
    models = Models(["a", "b"], np.log(np.full((1 << 16, 2), 0.5)))
    data = [(1, None), (2, ""), (3, "12 -- 34"), (4, "漢字"), (5, "word"), (5, "word"), (None, "w"), (6, "x" * 100_000), (7, "\x1c 1")]
    got = predict(spark.createDataFrame([(*x, "q") for x in data], "doc_id long, text string, score string"), models).collect()
    assert sorted((r.doc_id or 0, r.lang_pred, r.score) for r in got) == sorted((i or 0, "a" if k > 2 and k < 8 else "und", 1.0 if k > 2 and k < 8 else 0.0) for k, (i, _) in enumerate(data))
    none = fit(spark.createDataFrame([], "doc_id long, text string, lang string"), ~held_out())
    assert none.languages == [] and {r.lang_pred for r in predict(spark.createDataFrame(data, "doc_id long, text string"), none).collect()} == {"und"}
    assert predict(spark.createDataFrame([], "doc_id long, text string"), models).count() == 0


def test_more_than_256_languages(spark):
    """The rarest labels are learned too."""
    word = lambda k: "".join(chr(0x4E00 + 40 * k + i) for i in range(6))
    data = [(k * 10 + i, f"{word(k)} " * 5, f"l{k}") for k in range(270) for i in range(3 if k < 260 else 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    models = fit(docs, F.lit(True))
    assert models.languages == sorted(f"l{k}" for k in range(270))
    rare = docs.filter("lang IN ('l260', 'l269', 'l0')")
    assert {r.doc_id // 10: r.lang_pred for r in predict(rare, models).collect()} == {0: "l0", 260: "l260", 269: "l269"}
