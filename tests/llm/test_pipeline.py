"""The pipeline's stages against plain versions, each on what the one before kept."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tessel.llm.common import WRITTEN, clean
from tessel.llm.drr_packing import SEQUENCE
from tessel.llm.lang_mixture import fit, held_out
from tests.llm.test_lang_mixture import plain_mixture
from tests.llm.test_odd_sketches import plain as plain_components
from tests.llm.test_suffix_automata import plain as plain_removed

SF = "/root/testdata/sf0.001"


def rows(docs):
    return {r.doc_id: r for r in docs.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = [r.text.split()[:25] for lang in ("de", "en", "es", "fr") for r in docs.filter((F.col("lang") == lang) & F.col("n_chars").between(400, 1400)).orderBy("doc_id").limit(1).collect()]
    odd = spark.createDataFrame([(9010, " ".join(w for x in words for w in x)), (9001, None), (9002, "12 34"), (9003, ""), (9004, "zw"), (9005, "zw"), (9005, "zw")], "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "n_chars": F.char_length("text").cast("long")})
    docs = docs.unionByName(odd)
    before = rows(docs)

    models = fit(docs, ~held_out())
    kept = pipeline.language(spark, docs, SF)
    after = rows(kept)
    shares = {i: max(plain_mixture(r.text, models).values()) for i, r in before.items() if len(r.text or "") < 1500 and any(map(str.isalpha, r.text or ""))}
    gone = {i for i, x in shares.items() if x < pipeline.MAIN_SHARE} | {9001, 9002, 9003}
    assert kept.columns == docs.columns and set(before) - set(after) == gone and 9010 in gone and len(shares) > 50 and all(after[i] == before[i] for i in after)

    kept = pipeline.exact(spark, kept, SF)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect() if r.doc_id > 9000) == ["zw"]
    groups = {}
    for i, r in after.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), []).append((-len(r.text), i))
    after = rows(kept)
    assert sorted(after) == sorted(min(g)[1] for g in groups.values()) and kept.count() == len(after) < len(before)

    kept = pipeline.near(spark, kept, SF)
    want = plain_components([(i, r.text) for i, r in after.items()], 5)
    assert kept.columns == docs.columns and sorted(rows(kept)) == sorted(i for i, (_, root) in want.items() if i == root)
    after = rows(kept)

    kept = pipeline.passages(spark, kept, SF)
    assert kept.columns == docs.columns
    want = {i: (n, gone) for i, n, gone, _ in plain_removed([(i, r.text) for i, r in after.items()], pipeline.PASSAGE)}
    for i, r in rows(kept).items():
        assert len(r.text.split()) == want[i][0] - want[i][1] and (want[i][1] > 0 or r == after[i]) and r.n_chars == len(r.text)

    texts, library = {i: r.text for i, r in rows(kept).items()}, Tokenizer.from_file(public_tokenizers.path(pipeline.TOKENIZER))
    pieces = pipeline.packing(spark, kept, SF).collect()
    ids = {i: np.array([*library.encode(x, add_special_tokens=False).ids, 0], "<u4") for i, x in texts.items()}
    assert sorted(texts) == sorted(after) == sorted({p.doc_id for p in pieces})
    held, places = Counter(), Counter()
    for p in pieces:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id]) and len(part) == p.length > 0 and zlib.crc32(part.tobytes()) == p.ids_crc32
        held.update((p.doc_id, k) for k in range(p.start, p.start + p.length))
        places.update(p.sequence_id * SEQUENCE + k for k in range(p.offset, p.offset + p.length))
    # each id once, and places without gaps from 0: all sequences but the last are full
    total = sum(map(len, ids.values()))
    assert len(held) == total == sum(held.values()) and sorted(places) == list(range(total)) and max(places.values()) == 1


def test_run(spark):
    clean(spark)
    got = pipeline.run(spark, SF)
    # of the tables on the way only those that the last stage reads are left
    assert len([x for x in WRITTEN if not os.path.basename(x).startswith("rdd-")]) <= 6
    assert got.count() > 100 and [name for name, _ in pipeline.STAGES] == ["language", "exact", "near", "passages", "packing"]
