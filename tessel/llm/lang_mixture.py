"""Language proportions of a text by expectation-maximisation.

Each language has a model of letter trigrams.  A text is a bag of words, each drawn from one of the
languages; EM finds the proportions that make the words most likely.  Beginning with all languages, the one
with the smallest proportion is taken out as long as the loss of likelihood is less than the penalty for
having it, so the set that is left has the best penalised likelihood of that path.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm.common import bounded, small_batches, written

#: The models are fitted on at most so many labelled rows of each language, those with the smallest hashes of
#: their ids.  All languages are learned; a task counts so many at once, and so many come to the driver at once.
FIT_ROWS, LANGUAGES_AT_ONCE = 2000, 64
#: Buckets of trigrams, and what is added to each count.
BUCKETS, SMOOTHING = 1 << 16, 0.1
#: A language is worth PENALTY * log(words) of log-likelihood at least.
PENALTY = 3.0
#: A word counts at most so much more likely in one language than in another (in log-likelihood): a word
#: that no model knows says little.
SPREAD = 8.0
#: Steps of EM for a set of languages, and the (word, language) values that a task remembers, about.
STEPS, MEMORY = 8, 1_500_000
#: A longer word is several.
LONGEST = 32

UNKNOWN = "und"


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the trigrams around the words' letters, and of each the number of its word.

    Letters here are A-Z, a-z and all characters beyond ASCII.
    """
    marks = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.cumsum(marks == 10) - 1
    mid = marks[1:-1]
    letter = ((mid >= 97) & (mid <= 122)) | ((mid >= 65) & (mid <= 90)) | (mid > 127)
    key = (marks[:-2] * np.uint64(0x9E3779B1) + mid) * np.uint64(0x85EBCA77) + marks[2:]
    key = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return (key[letter] % np.uint64(BUCKETS)).astype(np.int64), word[1:-1][letter]


def words_of(text: str) -> list[str]:
    words = text.lower().split()
    if text and max(map(len, words), default=0) > LONGEST:
        words = [w[a : a + LONGEST] for w in words for a in range(0, len(w), LONGEST)]
    return words


@dataclass
class Models:
    """Log-probabilities [bucket, language] of the learned languages."""

    languages: list[str]
    logs: np.ndarray

    def of_words(self, words: list[str]) -> np.ndarray:
        """[word, language] log-likelihoods, less the word's best one; a word without a letter has zeros."""
        bucket, word = trigrams(words)
        out = np.zeros((len(words), len(self.languages)), np.float64)
        if len(bucket):
            at = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[at]] = np.add.reduceat(self.logs[bucket], at, axis=0)
        return np.maximum(out - out.max(axis=1, keepdims=True), -SPREAD)


def _expect(likely: np.ndarray, doc: np.ndarray, starts: np.ndarray, sizes: np.ndarray, weights: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions [text, language] after so many steps of EM, and the log-likelihoods with them."""
    ones = np.ones(likely.shape[1])
    for step in range(steps + 1):
        joint = likely * weights[doc]
        total = joint @ ones
        if step == steps:
            return weights, np.add.reduceat(np.log(total), starts)
        weights = np.add.reduceat(joint / total[:, None], starts, axis=0) / sizes[:, None]
    raise AssertionError


def mixtures(logs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Proportions [text, language] of texts of ``sizes`` words (all over 0), whose words have ``logs``."""
    n, k = len(sizes), logs.shape[1]
    starts = np.cumsum(sizes) - sizes
    alone = np.add.reduceat(logs, starts, axis=0)
    best = alone.argmax(axis=1)
    out = np.zeros((n, k))
    out[np.arange(n), best] = 1.0
    fine = PENALTY * np.log(sizes + 1.0)
    # a word's best language has 0, so no set of languages gets over 0: if one comes near that, it is the set
    open_ = np.flatnonzero(alone.max(axis=1) < -fine)
    if k == 1 or not len(open_):
        return out
    pick = np.isin(np.repeat(np.arange(n), sizes), open_)
    likely, own = np.exp(logs[pick]), sizes[open_]
    starts, doc, fine = np.cumsum(own) - own, np.repeat(np.arange(len(open_)), own), fine[open_]
    live = np.ones((len(open_), k), bool)
    weights, value = _expect(likely, doc, starts, own, live / k, STEPS)
    going = np.ones(len(open_), bool)
    for _ in range(k - 1):
        less = np.where(live, weights, np.inf).argmin(axis=1)
        tried = live.copy()
        tried[np.arange(len(open_)), less] = False
        tried[~going] = live[~going]
        begin = np.where(tried, weights + 1e-3, 0.0)
        new, got = _expect(likely, doc, starts, own, begin / begin.sum(axis=1, keepdims=True), STEPS)
        going &= got >= value - fine
        live[going], weights[going], value[going] = tried[going], new[going], got[going]
        if not going.any():
            break
    out[open_] = weights
    return out


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models:
    """Models of the languages of the rows where ``train`` holds, and text and language are not null.

    The models take half a MB a language, on the driver and in each worker.
    """
    rows = docs.filter(train & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    narrow = rows.select("_id", "_lang", F.shiftrightunsigned(F.xxhash64("_id", F.lit("fit")), 1).alias("_place"))
    sizes = written(narrow.groupBy("_lang").agg(F.count("*").alias("_n")), "languages")
    languages = sizes.count()
    # of each language about four times as many rows as are wanted, then the first of them
    near = narrow.join(bounded(sizes, languages, 64), "_lang").filter(F.col("_place") <= F.least(F.lit(1.0), 4.0 * FIT_ROWS / F.col("_n")) * float(1 << 63))
    by = Window.partitionBy("_lang").orderBy("_place", "_id")
    some = near.withColumn("_rank", F.row_number().over(by)).filter(F.col("_rank") <= FIT_ROWS).select("_id", "_lang").distinct()

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in small_batches(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang not in sums and len(sums) == LANGUAGES_AT_ONCE:
                    yield from tables(sums)
                    sums.clear()
                bucket, _ = trigrams(words_of(text))
                sums[lang] = sums.get(lang, np.zeros(BUCKETS, np.int64)) + np.bincount(bucket, minlength=BUCKETS)
        yield from tables(sums)

    def tables(sums):
        for lang, have in sums.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_pydict({"_lang": [lang] * len(at), "_bucket": pa.array(at), "_n": pa.array(have[at])})

    # FIT_ROWS ids of each language at most
    counts = rows.join(bounded(some, languages * FIT_ROWS, 64), ["_id", "_lang"], "left_semi").select("_lang", "_text").mapInArrow(count, "_lang string, _bucket long, _n long")
    counts = written(counts.groupBy("_lang", "_bucket").agg(F.sum("_n").alias("_n")), "trigrams")
    names = sorted(r["_lang"] for r in counts.select("_lang").distinct().collect())
    table = np.zeros((BUCKETS, len(names)))
    for at in range(0, len(names), LANGUAGES_AT_ONCE):
        some = {name: at + k for k, name in enumerate(names[at : at + LANGUAGES_AT_ONCE])}
        got = counts.filter(F.col("_lang").isin(list(some))).toPandas()
        table[got["_bucket"].to_numpy(np.int64), got["_lang"].map(some).to_numpy(np.int64)] = got["_n"].to_numpy()
    table += SMOOTHING
    table /= table.sum(axis=0)
    return Models(names, np.log(table, out=table))


def _predictions(models: Models, texts: list[str], memory: dict) -> tuple[list, list]:
    """The proportions of each text, or None, and how sure its words are of the language with the largest one.

    ``memory`` holds words' likelihoods and probabilities from call to call.
    """
    known, none = memory.setdefault("known", {}), np.zeros((0, len(models.languages)))
    rows, chances = memory.get("rows", none), memory.get("chances", none)
    lettered = [k for k, x in enumerate(texts) if any(map(str.isalpha, x)) and models.languages]
    shares: list = [None] * len(texts)
    sure = [0.0] * len(texts)
    at = 0
    while at < len(lettered):
        end, flat, sizes = at, [], []
        while end < len(lettered) and len(flat) * max(4, len(models.languages)) < 1_000_000:
            own = words_of(texts[lettered[end]])
            flat += own
            sizes.append(len(own))
            end += 1
        if len(known) * len(models.languages) > MEMORY:
            known.clear()
            rows = chances = none
        new = list(set(flat).difference(known))
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            own = models.of_words(new)
            rows = np.concatenate([rows, own])
            own = np.exp(own)
            chances = np.concatenate([chances, own / own.sum(axis=1, keepdims=True)])
        index, sizes = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat)), np.array(sizes)
        found = mixtures(rows[index], sizes)
        own = np.add.reduceat(chances[index, np.repeat(found.argmax(axis=1), sizes)], np.cumsum(sizes) - sizes) / sizes
        for k, share, x in zip(lettered[at:end], found, own.tolist()):
            shares[k], sure[k] = share, min(1.0, x)
        at = end
    memory["rows"], memory["chances"] = rows, chances
    return shares, sure


def predict(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row the id, ``lang_pred``, ``score`` (the proportion of that language), ``languages`` (the proportions
    of all that are in the text) and ``sure``.

    ``sure`` is the mean over the text's words of the probability that a word is of ``lang_pred``, all languages being
    as likely beforehand: 1 only if no other language could have the words, and 1 / languages if they tell nothing.

    A null text, one without a letter, and any text if no language was learned is ``und``, score and ``sure`` 0.  Ties
    go to the first language in alphabetical order.  Whole texts are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        models, memory = held.value, {}
        for b in small_batches(batches):
            shares, sure = _predictions(models, [x or "" for x in b.column(1).to_pylist()], memory)
            best = [None if x is None else int(x.argmax()) for x in shares]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([UNKNOWN if k is None else models.languages[k] for k in best]), pa.array([0.0 if k is None else min(1.0, float(x[k])) for k, x in zip(best, shares)], pa.float64()),
                    pa.array([[] if x is None else [(models.languages[k], float(x[k])) for k in np.flatnonzero(x > 1e-6)] for x in shares], pa.map_(pa.string(), pa.float64())), pa.array(sure, pa.float64()),
                ],
                ["_id", "lang_pred", "score", "languages", "sure"],
            )

    got = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"_id {kind}, lang_pred string, score double, languages map<string,double>, sure double")
    return got.withColumnRenamed("_id", id_col)


def with_main_language(docs: DataFrame, models: Models, share: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that have a language of at least ``share`` of the text.

    Texts that ``predict`` calls ``und`` are not among them.
    """
    held = docs.sparkSession.sparkContext.broadcast(models)
    at = docs.columns.index(text_col)

    def run(batches):
        models, memory = held.value, {}
        for b in small_batches(batches):
            shares, _ = _predictions(models, [x or "" for x in b.column(at).to_pylist()], memory)
            yield b.filter(pa.array([x is not None and float(x.max()) >= share for x in shares], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from fitting: CRC-32 of the id as text leaves 2 when divided by 4.  A null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
