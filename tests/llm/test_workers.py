"""What Python workers keep from task to task."""

import public_tokenizers
import pyarrow as pa

from ledgerline.llm import batches, bpe, bytelevel, decontamination, near_dedup
from ledgerline.llm.queries import TOKENIZER


def test_a_task_gives_up_what_other_operators_kept():
    raw = bytelevel.read_file(public_tokenizers.path(TOKENIZER))
    kept = bpe.encoder(raw).encode(["one two"]), near_dedup.shingle_set(b"one two", 5).tolist(), decontamination.numbers_of([["one"]]).tolist()
    assert bpe._ENCODERS and near_dedup._words and decontamination._NUMBERS
    rows = type("Rows", (), {"mapInArrow": lambda self, run, schema: list(run([pa.RecordBatch.from_pydict({"body": [b"a"]})]))})()

    def function(part):
        return {"n": [part.num_rows]}

    function.__module__ = near_dedup.__name__
    assert batches.map_slices(rows, function, "n long")[0].to_pydict() == {"n": [1]}
    assert near_dedup._words and not bpe._ENCODERS and not decontamination._NUMBERS
    batches.begin_task("ledgerline.llm.toxicity")
    assert not near_dedup._words and not bytelevel.tables.cache_info().currsize
    assert kept == (bpe.encoder(raw).encode(["one two"]), near_dedup.shingle_set(b"one two", 5).tolist(), decontamination.numbers_of([["one"]]).tolist())
