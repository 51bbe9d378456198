"""The queries of this subpackage: thin wrappers that give the operators their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.bloom_urls import judge_urls
from tessel.llm.common import scratch, table
from tessel.llm.drr_packing import pack
from tessel.llm.golomb_dedup import exact_dedup
from tessel.llm.lang_mixture import fit, held_out, predict
from tessel.llm.linmax import token_counts
from tessel.llm.odd_sketches import near_duplicates
from tessel.llm.repair_store import read_ids, write_ids
from tessel.llm.suffix_automata import remove_repeats
from tessel.llm.suffix_repeats import repetition_rules
from tessel.llm.tree_bpe import encode_decode

#: Host, path and verdict of the listed entries.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: URLs that are blocked as a whole, where no entry fits: in canonical form they are compared with all pages.
BLOCKED_URLS = ["https://thther.example.org/en/685/", "http://ththed.example.org/en/453#top", "https://blog.ththly.example.org:443/en/777?ref=x&page=2&utm_source=feed", "http://spam-farm.example.org/en/728"]

#: Name of the tokenizer file that the queries use.
TOKENIZER = "byte_bpe_50k.json"


def op1_repair_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "store")
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return read_ids(spark, path, digest=True)


def op2_linmax_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))


def op4_drr_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_bloom_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    urls = spark.createDataFrame([(x, "block") for x in BLOCKED_URLS], "url string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), listed, urls=urls)


def op6_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), window=35, digest=True)


def op7_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), digests=True)


def op8_lang_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score`` is the language's proportion times how sure the words are of it."""
    docs = table(spark, sf_dir, "documents")
    got = predict(docs, fit(docs, ~held_out()))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", (F.col("score") * F.col("sure")).alias("score"))


def op9_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op10_golomb_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_repair_store": op1_repair_store,
    "op2_linmax_counts": op2_linmax_counts,
    "op3_suffix_repetition": op3_suffix_repetition,
    "op4_drr_packing": op4_drr_packing,
    "op5_bloom_urls": op5_bloom_urls,
    "op6_suffix_automata": op6_suffix_automata,
    "op7_tree_bpe": op7_tree_bpe,
    "op8_lang_mixture": op8_lang_mixture,
    "op9_odd_sketches": op9_odd_sketches,
    "op10_golomb_dedup": op10_golomb_dedup,
}

ORACLE_SQL = {
    "op5_bloom_urls": r"""
        WITH u AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
                   list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND string_split(x, '=')[1] NOT IN ('fbclid', 'gclid', 'ref'))) AS said
            FROM pages),
        c AS (SELECT *, regexp_replace(host, ':(80|443)$', '') || rtrim(path, '/') || CASE WHEN len(said) > 0 THEN '?' || array_to_string(said, '&') ELSE '' END AS canonical FROM u),
        r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
        SELECT page_id, host, path,
               (SELECT h || p FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1) AS rule,
               coalesce((SELECT v FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC LIMIT 1),
                        CASE WHEN canonical IN ('thther.example.org/en/685', 'ththed.example.org/en/453', 'blog.ththly.example.org/en/777?page=2', 'spam-farm.example.org/en/728') THEN 'block' ELSE 'allow' END) AS verdict
        FROM c""",
    "op6_suffix_automata": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM w, range(1, len(ws) - 33) r(i)),
        again AS (SELECT k FROM p GROUP BY k HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM p SEMI JOIN again USING (k), range(0, 35) x(j)),
        left_ AS (SELECT doc_id, count(*) AS n, sha256(string_agg(word, ' ' ORDER BY pos)) AS h FROM (SELECT doc_id, pos, ws[pos] AS word FROM w, range(1, len(ws) + 1) t(pos)) a ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, coalesce(h, sha256('')) AS kept_sha256 FROM w LEFT JOIN left_ USING (doc_id)""",
    "op9_odd_sketches": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 1], ' ') AS g FROM w, range(1, greatest(len(ws), 2)) r(i) WHERE len(ws) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
        e2 AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
        reach AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT e2.y, root FROM reach JOIN e2 ON e2.x = reach.doc_id)
        SELECT w.doc_id, coalesce(n, 0) AS n_shingles, c.root AS component_id, w.doc_id = c.root AS kept FROM w JOIN (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id) c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op10_golomb_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents),
        k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM k""",
}
