from __future__ import annotations

import random

import pytest

pytest.importorskip("lockgrain.llm")
pytest.importorskip("public_tokenizers")
from lockgrain.llm.tokens import Encoder, Vocabulary, encode_corpus  # noqa: E402

PIECES = [
    " ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "a", "b", "hello", "the", " world", "éa", "漢", "😀", "1", "23", "...", "!", "<|endoftext|>", "aaaaaaaa", "        ", "I'", "　", "ﬁ", "٣", "x" * 30,
    "ab" * 20, " " * 40, "=-" * 30,
]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load()


def test_tree_concatenation_equals_whole(vocabulary):
    e = Encoder(vocabulary, piece=16)
    rng = random.Random(11)
    for _ in range(600):
        s = "".join(rng.choice(PIECES if rng.random() < 0.7 else PIECES[-9:]) for _ in range(rng.randint(1, 60)))
        size = rng.choice([1, 2, 3, 5, 8, 13, 40, 100])
        assert e.encode_long(s, size).tolist() == e.encoding.encode_ordinary(s), (s, size)


def test_long_unsplit_pieces(vocabulary):
    e = Encoder(vocabulary)
    for s in ("a" * 150_000, " " * 150_000 + "x", "é" * 70_000, "helloworld" * 15_000):
        assert e.encode_long(s, 1 << 14).tolist() == e.encoding.encode_ordinary(s)


def test_same_ids_as_the_other_library(vocabulary):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    e = Encoder(vocabulary)
    for s in ("plain words, it's 3.14 <|endoftext|> and 漢字 😀\n\n  x", "".join(PIECES)):
        assert e.encode(s).tolist() == t.encode(s, add_special_tokens=False).ids


def test_corpus(spark, vocabulary):
    e = Encoder(vocabulary)
    texts = [(1, "ab" * 50), (2, None), (3, ""), (4, " " * 100 + "x"), (5, "ab" * 50), (1, "ab" * 50), (6, " \n"), (7, "<|endoftext|>")]
    df = spark.createDataFrame([(i, t, "n", 7) for i, t in texts], "doc_id long, text string, `key` string, ids int")
    for long in (7, 1 << 16):
        rows = encode_corpus(df, long=long).collect()
        assert sorted((r.doc_id, r.ids) for r in rows) == sorted((i, e.encode(t).tolist()) for i, t in texts)
        counts = encode_corpus(df, keep=("doc_id", "key"), out="n", counts_only=True, long=long).collect()
        assert sorted((r.doc_id, r.n) for r in counts) == sorted((i, len(e.encode(t))) for i, t in texts)
    assert encode_corpus(df.limit(0)).collect() == []


def test_many_segments_join_level_by_level(spark, vocabulary):
    e = Encoder(vocabulary)
    rng = random.Random(6)
    texts = [(i, "".join(rng.choice(PIECES) for _ in range(n))) for i, n in enumerate((3, 40, 90, 400, 700))] + [(9, "a" * 5000), (10, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = encode_corpus(df, long=37).collect()
    assert sorted((r.doc_id, r.ids) for r in rows) == [(i, e.encode(t).tolist()) for i, t in texts]
