import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import bpe, bytelevel, token_counts
from tests.llm.cases import TEXTS, documents, nothing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def random_texts(seed, n=400):
    rng = random.Random(seed)
    letters = ["abc ", "THE of", " .,!?'", "0123456789", "éüñßçø", "漢字かな", "ԱԲ՘ऄ", "\U0001f600‍", " \n\t\r 　\x85\x1c", "'s't're<|endoftext|>"]
    return ["".join(rng.choice(rng.choice(letters)) for _ in range(rng.randrange(120))) for _ in range(n)] + ["a" * 3000, " " * 999 + "x", "ab" * 700, "".join(rng.choice("abcdef") for _ in range(5000))]


@pytest.fixture(scope="module")
def raw():
    return bytelevel.read_file(PATH)


@pytest.mark.parametrize("seed", [1, 2])
def test_ids_counts_and_texts_are_those_of_the_library(raw, seed):
    texts = random_texts(seed)
    expected = [ids_of(text) for text in texts]
    encoder = bpe.TrieEncoder(raw)
    assert encoder.encode(texts) == expected
    assert [encoder.decode(ids) for ids in expected] == texts
    assert token_counts.ArrayCounter(raw).count(texts) == [len(ids) for ids in expected]


def test_every_token_is_its_own_encoding(raw):
    encoder = bpe.TrieEncoder(raw)
    found = encoder.encode_words(set(encoder.t.ids))
    assert all(found[word] == (token,) for word, token in encoder.t.ids.items())


def test_words_are_forgotten_without_harm(raw, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 3)
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 5)
    encoder, counter = bpe.TrieEncoder(raw), token_counts.ArrayCounter(raw)
    for text in random_texts(3, 60):
        assert encoder.encode([text])[0] == ids_of(text)
        assert counter.count([text]) == [len(ids_of(text))]


def test_round_trip_of_rows(spark):
    rows = bpe.round_trip(documents(spark), PATH).collect()
    expected = []
    for text in TEXTS:
        ids = ids_of(text)
        expected.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == sorted(expected)
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(["None", *map(str, range(len(TEXTS) - 2)), "0"])
    assert bpe.round_trip(nothing(spark), PATH).count() == 0


def test_encode_then_decode(spark):
    docs = documents(spark)
    tokens = bpe.encode(docs, PATH)
    assert sorted(r["text"] for r in bpe.decode(tokens, PATH).collect()) == sorted(t or "" for t in TEXTS)
    checked = bpe.encode_and_check(docs, PATH).collect()
    assert all(r["intact"] and r["n_tokens"] == len(r["ids"]) for r in checked) and len(checked) == len(TEXTS)


def test_counts_of_rows(spark):
    rows = token_counts.count_tokens(documents(spark), PATH, limit=3).collect()
    expected = [(len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 3) for t in TEXTS]
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows) == sorted(expected)
    assert token_counts.count_tokens(nothing(spark), PATH).count() == 0


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError):
        bytelevel.tables(bytelevel.read_file(public_tokenizers.path("word_bpe_49k.json")))
