import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from ledgerline.llm import chunked_bpe, queries
from tests.llm.cases import TEXTS, documents, nothing
from tests.llm.test_tokens import random_texts

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
with open(PATH, "rb") as _file:
    RANKS = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, _file)}
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def own():
    return chunked_bpe.RankEncoder(chunked_bpe.read_ranks(PATH), chunked_bpe.cutter(PATTERN))


def unpacked(ids):
    return np.frombuffer(ids, "<u4").tolist()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ids_and_bytes_are_those_of_the_library(own, seed):
    texts = random_texts(seed)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert unpacked(ids) == LIBRARY.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_characters_of_every_class_are_cut_as_the_library_cuts_them(own):
    rng = random.Random(5)
    points = [point for point in range(0x110000) if not 0xD800 <= point < 0xE000]
    for _ in range(300):
        text = "".join(rng.choice(" a1.") + chr(rng.choice(points)) + rng.choice(["", "b", " "]) for _ in range(300))
        assert unpacked(own.encode([text])[0]) == LIBRARY.encode_ordinary(text)


def test_words_are_forgotten_without_harm(own, monkeypatch):
    monkeypatch.setattr(chunked_bpe, "KEPT_WORDS", 5)
    monkeypatch.setattr(chunked_bpe, "PIECES", 7)
    for text in random_texts(3, 60) + ["word " * 20_000]:
        assert unpacked(own.encode([text])[0]) == LIBRARY.encode_ordinary(text)


def test_both_ways_of_encoding_a_piece_agree(own):
    rng = random.Random(9)
    pieces = {"".join(rng.choices("abcdeé漢 ", k=rng.randrange(1, 60))).encode() for _ in range(3000)} | {bytes(rng.choices(range(256), k=20)) for _ in range(500)}
    pieces |= set(rng.sample(sorted(own.ranks), 2000)) | {b"a" * n for n in range(1, 200)}
    pieces = sorted(pieces)
    assert [unpacked(ids) for ids in own.encode_words(pieces)] == [own.by_heap(piece) for piece in pieces]


def test_patterns_that_cannot_be_spelled_out():
    with pytest.raises(ValueError):
        chunked_bpe.cutter(r"\w+|\p{Lu}")


def test_a_long_piece_takes_no_quadratic_time(own):
    text = "".join(random.Random(1).choices("abcdefghij", k=200_000))
    assert unpacked(own.encode([text])[0]) == LIBRARY.encode_ordinary(text)


def test_what_a_chunk_is_sure_of_is_so_in_the_whole_text(own):
    for text in random_texts(7, 300):
        sure = set(chunked_bpe.boundaries(text, own.cut, last=True))
        for end in range(1, len(text)):
            assert set(chunked_bpe.boundaries(text[:end], own.cut, last=False)) <= sure


@pytest.mark.parametrize(("chunk", "overlap"), [(7, 3), (40, 12), (200, 50)])
def test_stitched_texts(spark, chunk, overlap):
    texts = [*random_texts(4, 120), "x" * 1000, " " * 300 + "y", "it's " * 100, "a" * 33 + " b c d " + "1" * 90 + " e's" * 20, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["ids"] for r in chunked_bpe.encode(docs, PATH, PATTERN, chunk=chunk, overlap=overlap).collect()}
    assert found == {i: LIBRARY.encode_ordinary(text or "") for i, text in enumerate(texts)}
    decoded = chunked_bpe.decode(chunked_bpe.encode(docs, PATH, PATTERN, chunk=chunk, overlap=overlap), PATH)
    assert {r["doc_id"]: bytes(r["decoded"]) for r in decoded.collect()} == {i: (text or "").encode() for i, text in enumerate(texts)}


def expected(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_round_trip_of_rows(spark):
    rows = chunked_bpe.round_trip(documents(spark), PATH, PATTERN).collect()
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == sorted(map(expected, TEXTS))
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(["None", *map(str, range(len(TEXTS) - 2)), "0"])
    assert chunked_bpe.round_trip(nothing(spark), PATH, PATTERN).count() == 0


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(X'61FF20C3' AS string) AS text")
    (row,) = chunked_bpe.encode(docs, PATH, PATTERN).collect()
    assert row["ids"] == LIBRARY.encode_ordinary("a� �")


def test_registered_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    rows = queries.op11_byte_bpe_chunks(spark, FOLDER)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, rows.collect())) == sorted((r["doc_id"], *expected(r["text"])) for r in docs)
