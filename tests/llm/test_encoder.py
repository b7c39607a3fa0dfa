"""What an encoder holds while it works."""

import gc

import public_tokenizers

from ledgerline.llm import batches, bpe


def test_the_encoder_works_on_small_slices_without_the_collector(spark, monkeypatch):
    sizes, encode = [], bpe.TrieEncoder.encode_words

    def watched(self, words):
        assert not gc.isenabled()
        return encode(self, words)

    monkeypatch.setattr(bpe.TrieEncoder, "encode_words", watched)
    monkeypatch.setattr(bpe, "map_slices", lambda df, function, schema, limit=batches.SLICE_BYTES: sizes.append(limit) or batches.map_slices(df, function, schema, limit=limit))
    path = public_tokenizers.path("byte_bpe_50k.json")
    bpe.encoder(bpe.bytelevel.read_file(path)).encode(["some words, some more"])
    assert gc.isenabled()
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [r["n_tokens"] for r in bpe.round_trip(docs, path).orderBy("doc_id").collect()][1] == 0
    bpe.encode(docs, path), bpe.encode_and_check(docs, path)
    assert len(sizes) == 3 and max(sizes) <= 2 << 20
