import base64
import os
import time

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from plenarium.llm import encode

FOLDER = os.environ.get("PLENARIUM_TOKENIZERS", encode.TOKENIZERS)
PATH = f"{FOLDER}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def oracle():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{FOLDER}/byte_bpe_50k.tiktoken", "rb"))}
    return tiktoken.Encoding("own", pat_str=encode.WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def ids(text):
    vocab = encode.vocabulary(PATH)
    return [t for ts in vocab.encode_words(regex.findall(encode.WORDS, text)) for t in ts]


@settings(max_examples=400, deadline=None)
@given(text=st.text(st.characters(exclude_categories=("Cs",)), max_size=80))
def test_any_text(oracle, text):
    assert ids(text) == oracle(text)


def test_speculation_fails_and_is_mended(oracle):
    vocab = encode.vocabulary(PATH)
    words = [f" {a}{b}" for a in ("unhapp", "Zanfreholm", "redis", "Łobã", "xqzt") for b in ("iness", "tribut", "mar", "úl", "aaaaaaaa")]
    assert any(vocab.greedy(w.encode()) != oracle(w) for w in words)
    assert vocab.encode_words(words) == [oracle(w) for w in words]


@settings(max_examples=300, deadline=None)
@given(word=st.text(st.sampled_from("abxyz qéß\u0430"), min_size=1, max_size=60))
def test_exact_merging(oracle, word):
    vocab = encode.vocabulary(PATH)
    for w in regex.findall(encode.WORDS, word):
        assert vocab.merged(w.encode()) == oracle(w)


def test_a_word_of_a_million_letters():
    vocab = encode.vocabulary(PATH)
    word = ("xqzab" * 200_000).encode()
    began = time.perf_counter()
    tokens = vocab.merged(word)
    assert time.perf_counter() - began < 60
    letters = {i: t for t, i in vocab.ids.items()}
    assert b"".join(letters[t] for t in tokens) == word and tokens[:40] == vocab.merged(word[:1000])[:40]


def test_rows(spark, oracle):
    texts = ["A text.", None, "", "  ", "<|endoftext|>", "A text.", "é🙂 " * 30_000, "x" * 5_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "z", 1)], "doc_id long, text string, ids int")
    got = encode.encode_corpus(df, "doc_id", "text", PATH)
    assert dict(got.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    rows = {r["doc_id"]: r["ids"] for r in got.collect()}
    assert rows == {i: oracle(t) if t else [] for i, t in enumerate(texts)} | {None: oracle("z")}
    assert encode.encode_corpus(df.limit(0), "doc_id", "text", PATH).count() == 0
