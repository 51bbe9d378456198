"""Tree concatenation against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import tessel.llm.tree_bpe as module
from tessel.llm.tokens import Encoder
from tessel.llm.tree_bpe import TreeEncoder, encode_decode, written_bytes

PATH = public_tokenizers.path("byte_bpe_50k.json")


def long_texts(seed, n):
    r = random.Random(seed)
    runs = [
        lambda k: "".join(r.choice("abcdeéßthioning") for _ in range(k)), lambda k: r.choice(["a", "ab", "the", "ions"]) * k, lambda k: r.choice([" ", "\n", " \t", "　"]) * k,
        lambda k: "".join(r.choice("0123456789") for _ in range(k)), lambda k: "".join(r.choice("#-=!'_.") for _ in range(k)), lambda k: "漢字" * k,
        lambda k: " ".join(r.choice(["the", "thing", "it's", "x,", "\n", "\x1c", "\x85", ""]) for _ in range(k)),
    ]
    return ["".join(r.choice(runs)(r.choice([1, 2, 5, 30, 200, 700])) for _ in range(r.randrange(1, 8))) for _ in range(n)]


def test_trees():
    library, tree = Tokenizer.from_file(PATH), TreeEncoder(Encoder(PATH))
    for leaf in (8, 64):
        module_leaf, module.LEAF = module.LEAF, leaf
        try:
            for x in long_texts(leaf, 60):
                for word in x.split():
                    if word.isalpha():
                        assert tree.tree(written_bytes(word.encode())) == library.encode(word, add_special_tokens=False).ids, word
        finally:
            module.LEAF = module_leaf


def test_whole_texts():
    library, tree = Tokenizer.from_file(PATH), TreeEncoder(Encoder(PATH))
    for x in long_texts(5, 150):
        want = library.encode(x, add_special_tokens=False).ids
        got = np.frombuffer(tree.encode_many([x])[0], tree.enc.type)
        assert got.tolist() == want, repr(x)
        assert tree.decode(got) == library.decode(want, skip_special_tokens=False)


def test_rows(spark, monkeypatch):
    library = Tokenizer.from_file(PATH)
    monkeypatch.setattr(module, "LONG_TEXT", 50)
    texts = [None, "", " ", "\n\n", "a b", "x <|endoftext|> y", "word " * 30000, "z" * 100_000, *long_texts(7, 30)]
    data = [(i, x, "n") for i, x in enumerate(texts)] + [(500, texts[-1], "n")] * 2
    got = encode_decode(spark.createDataFrame(data, "doc_id long, text string, n_tokens string").repartition(4), PATH, digests=True).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in data)
    for r in got:
        ids = library.encode(dict((i, x) for i, x, _ in data)[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert {r.doc_id: r.decoded for r in encode_decode(spark.createDataFrame(data[:5], "doc_id long, text string, n string"), PATH).collect()}[4] == "a b"
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
