"""URL filter: a blocked Bloom filter before an exact join with the listed canonical URLs.

Two lists can be given.  Entries are a host and the start of a path, and fit all subdomains; listed URLs are
compared as a whole, in canonical form.  Each row makes its own keys: its canonical URL, the suffixes of its host (by
labels, as many as entries have), and for hosts that may be listed the starts of its path (as long as entries
have, and never longer than the path).  The filter, broadcast and of bounded size, is asked row by row; a row none of
whose keys may be listed is done, without any shuffle.  The others go to an exact join with the list, key by key, which
removes what the filter let through by mistake.  A URL that very many rows have is as many rows there, spread by row.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import BROADCAST_BYTES, small_batches

#: A block is 8 words of 64 bits, one cache line; a key sets one bit in each word of its block.
WORDS = 8
#: Bits of the filter for each listed entry, and the most bytes that it takes.
BITS_A_KEY, MAX_BYTES = 24, 16 << 20
#: A hot key of the URL side is spread over so many copies of each entry, where the list isn't broadcast.
SALTS = 16
#: Parameters of a query that tell where a reader came from, not which page it is: by their start, and by their name.
TRACKING, TRACKERS = "utm_", ("fbclid", "gclid", "ref")


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From after the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash the places of its 8 words and the bit in each."""
    h = hashes.view(np.uint64)
    block = (h >> np.uint64(40)) & np.uint64(blocks - 1)
    word = block[:, None] * np.uint64(WORDS) + np.arange(WORDS, dtype=np.uint64)
    shift = (h[:, None] >> np.arange(0, 5 * WORDS, 5, dtype=np.uint64)) & np.uint64(31)
    odd = (h[:, None] >> np.uint64(39)) & np.uint64(1)
    return word.astype(np.int64), np.uint64(1) << (shift * np.uint64(2) + odd)


class BlockedBloom:
    """A filter of ``blocks`` blocks (a power of two)."""

    def __init__(self, words: np.ndarray):
        self.words, self.blocks = words, len(words) // WORDS

    @staticmethod
    def blocks_for(keys: int) -> int:
        need = max(1, -(-keys * BITS_A_KEY // (64 * WORDS)))
        return min(1 << (need - 1).bit_length(), MAX_BYTES // (8 * WORDS))

    @classmethod
    def of(cls, hashes: np.ndarray, blocks: int) -> BlockedBloom:
        words = np.zeros(blocks * WORDS, np.uint64)
        at, bit = _bits(hashes, blocks)
        np.bitwise_or.at(words, at.ravel(), bit.ravel())
        return cls(words)

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        at, bit = _bits(hashes, self.blocks)
        return ((self.words[at] & bit) != 0).all(axis=1)


def build_filter(keys: DataFrame, count: int) -> BlockedBloom:
    """The filter of a table of hashes: partitions send blocks of their own, which are or-ed together.

    What comes to the driver is at most MAX_BYTES, whatever the list's size.
    """
    blocks = BlockedBloom.blocks_for(count)

    def partial(batches: Iterable[pd.DataFrame]):
        words = np.zeros(blocks * WORDS, np.uint64)
        for b in batches:
            words |= BlockedBloom.of(b["_hash"].to_numpy(np.int64), blocks).words
        at = np.flatnonzero(words)
        yield pd.DataFrame({"_at": at, "_word": words[at].view(np.int64)})

    got = keys.select("_hash").mapInPandas(partial, "_at long, _word long").groupBy("_at").agg(F.bit_or("_word").alias("_word")).toPandas()
    words = np.zeros(blocks * WORDS, np.uint64)
    words[got["_at"].to_numpy()] = got["_word"].to_numpy(np.int64).view(np.uint64)
    return BlockedBloom(words)


def _hashes(keys: list[str]) -> np.ndarray:
    """The hashes that Spark's ``xxhash64`` gives strings."""
    return np.fromiter((xxhash.xxh64_intdigest(x.encode(), 42) for x in keys), np.uint64, len(keys)).view(np.int64)


def canonical_url(url: Column) -> Column:
    """A URL's canonical form: the same for all addresses of one page.

    It has no scheme and no fragment, the host in small letters without the ports 80 and 443, the path without slashes
    at its end, and the parameters of the query in order, without those that only track.  Null and what has no
    ``://`` give null.
    """
    host = F.regexp_replace(host_of(url), r":(?:80|443)\z", "")
    path = F.regexp_replace(path_of(url), r"/+\z", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)", 1)
    name = lambda x: F.substring_index(x, "=", 1)
    said = F.array_sort(F.filter(F.split(query, "&", -1), lambda x: (x != "") & ~x.startswith(TRACKING) & ~name(x).isin(*TRACKERS)))
    return F.when(url.contains("://"), F.concat(host, path, F.when(F.size(said) > 0, F.concat(F.lit("?"), F.array_join(said, "&"))).otherwise(F.lit(""))))


def judge_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", urls: DataFrame | None = None) -> DataFrame:
    """A verdict for each row of ``pages`` by the longest listed entry that fits its URL, or by its listed URL.

    ``listed`` has ``host``, ``path`` and ``verdict``.  An entry fits its host and all subdomains, if the
    URL's path starts with its own.  Of entries of one length (host and path together), which can't differ
    in host and path both, block goes before allow.  A URL with no entry gets the verdict of ``urls`` (``url``,
    ``verdict``; block before allow) if that table has one of the same canonical form, else ``default``.

    Null URLs and those without ``://`` have an empty host and path, which fit nothing.  Repeated rows each
    get their row; an empty table or an empty list is no special case.

    Returns the id, ``host``, ``path``, ``rule`` (host and path of the entry; else null) and ``verdict``.
    """
    spark = pages.sparkSession
    rules = listed.select(F.coalesce("host", F.lit("")).alias("_h"), F.coalesce("path", F.lit("")).alias("_p"), "verdict").filter("_h <> ''")
    shape = rules.agg(F.collect_set(F.size(F.split("_h", r"\."))).alias("labels"), F.collect_set(F.char_length("_p")).alias("chars")).first()
    exact = rules.select(F.concat("_h", F.lit("\n"), "_p").alias("_key"), F.concat("_h", "_p").alias("_rule"), (F.char_length("_h") + F.char_length("_p")).alias("_n"), "verdict")
    if urls is not None:
        whole = urls.select(F.concat(F.lit("\n"), canonical_url(F.col("url"))).alias("_key"), F.lit(None).cast("string").alias("_rule"), F.lit(-1).alias("_n"), "verdict")
        exact = exact.unionByName(whole.filter("_key IS NOT NULL"))
    exact = exact.groupBy("_key", "_rule", "_n").agg(F.max("verdict").alias("_verdict"))
    size = exact.agg(F.count("*").alias("n"), F.sum(F.octet_length("_key") + 64).alias("bytes")).first()
    rows = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("_host"), path_of(F.col(url_col)).alias("_path"), *([canonical_url(F.col(url_col)).alias("_url")] if urls is not None else []))
    out = [F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path")]
    if not size["n"]:
        return rows.select(*out, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hosts = rules.select(F.concat(F.lit("host\n"), "_h").alias("_key")).distinct()
    hashes = exact.select(F.xxhash64("_key").alias("_hash")).unionByName(hosts.select(F.xxhash64("_key").alias("_hash")))
    bloom = spark.sparkContext.broadcast(build_filter(hashes, 2 * size["n"]))

    kind = pages.schema[id_col].dataType.simpleString()
    suffixes, starts = sorted(shape["labels"]), sorted(shape["chars"])
    names, whole_urls = [*rows.columns, "_keys"], urls is not None

    def ask(batches):
        """The keys of each row that may be listed: of its hosts first, then of paths on those that may be."""
        filter_ = bloom.value
        for b in small_batches(batches, 10_000):
            hosts: list[str] = []
            owner: list[int] = []
            for k, host in enumerate(b.column("_host").to_pylist()):
                if host:
                    parts = host.split(".")
                    some = [".".join(parts[-n:]) for n in suffixes if n <= len(parts)]
                    hosts += some
                    owner += [k] * len(some)
            paths = b.column("_path").to_pylist()
            keys: list[str] = []
            own: list[int] = []
            for at in np.flatnonzero(filter_.may_have(_hashes([f"host\n{x}" for x in hosts]))).tolist():
                path = paths[owner[at]]
                some = [f"{hosts[at]}\n{path[:n]}" for n in starts if n <= len(path)]
                keys += some
                own += [owner[at]] * len(some)
            if whole_urls:
                for k, url in enumerate(b.column("_url").to_pylist()):
                    if url is not None:
                        keys.append("\n" + url)
                        own.append(k)
            out: list[list[str]] = [[] for _ in range(b.num_rows)]
            for at in np.flatnonzero(filter_.may_have(_hashes(keys))).tolist():
                out[own[at]].append(keys[at])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.string()))], names)

    text = "".join(f", {x} string" for x in names[1:-1])
    rows = rows.mapInArrow(ask, f"_id {kind}{text}, _keys array<string>").withColumn("_row", F.monotonically_increasing_id())

    # what may be listed is looked up; each row's copies of its keys meet again by the row's number
    hits = rows.filter(F.size("_keys") > 0).select("_id", "_host", "_path", "_row", F.explode("_keys").alias("_key"))
    if size["bytes"] <= BROADCAST_BYTES:
        found = hits.join(F.broadcast(exact), "_key", "left")
    else:
        salted = exact.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        found = hits.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(salted, ["_key", "_salt"], "left")
    best = F.max(F.struct(F.coalesce("_n", F.lit(-2)).alias("n"), "_verdict", "_rule"))
    judged = found.groupBy("_row").agg(F.first("_id").alias("_id"), F.first("_host").alias("_host"), F.first("_path").alias("_path"), best.alias("_best"))
    judged = judged.select(*out, F.col("_best._rule").alias("rule"), F.coalesce("_best._verdict", F.lit(default)).alias("verdict"))
    return rows.filter(F.size("_keys") == 0).select(*out, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")).unionByName(judged)
