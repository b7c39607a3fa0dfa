"""Token counts by merging many words at once: ragged arrays of symbols, one merge rank per word and step."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerline.llm import bytelevel
from ledgerline.llm.batches import bodies, id_and_text, map_slices

NO_RANK = np.int64(1) << 40
KEPT_WORDS = 400_000
LONGEST_KEPT = 64


class ArrayCounter:
    """Counts tokens with the tables of a byte-level BPE file."""

    def __init__(self, raw: bytes):
        self.t = bytelevel.tables(raw)
        pairs = np.array([a << 32 | b for a, b in self.t.merges], np.int64)
        order = np.argsort(pairs)
        made = np.array(list(self.t.merges.values()), np.int64).reshape(-1, 2)[order]
        self._pairs, self._ranks, self._made = pairs[order], made[:, 0], made[:, 1]
        self._by_rank = np.zeros(len(self.t.merges) + 1, np.int64)
        self._by_rank[self._ranks] = self._made
        self._first = np.array(self.t.first_ids, np.int64)
        self.words: dict[str, int] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
        return np.where(self._pairs[at] == pair, self._ranks[at], NO_RANK)

    def count_words(self, words: list[bytes]) -> np.ndarray:
        """The number of tokens of each word.

        All words lie one after the other in one array. In each step every unfinished word has its pair of
        lowest rank merged, wherever that pair is; of overlapping places the first, third and so on count.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.zeros(len(words), np.int64)
        alive = np.flatnonzero(sizes)
        symbols = self._first[np.frombuffer(b"".join(words), np.uint8)]
        sizes = sizes[alive]
        rank = np.full(len(symbols), NO_RANK)
        ends = np.cumsum(sizes) - 1
        if len(symbols):
            rank[:-1] = self._rank(symbols[:-1], symbols[1:])
            rank[ends] = NO_RANK
        while len(alive):
            starts = np.cumsum(sizes) - sizes
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NO_RANK
            if done.any():
                counts[alive[done]] = sizes[done]
                stays = np.repeat(~done, sizes)
                symbols, rank = symbols[stays], rank[stays]
                alive, sizes, lowest = alive[~done], sizes[~done], lowest[~done]
                if not len(alive):
                    break
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(rank == lowest[owner])
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            first = np.repeat(at[run], np.diff(run, append=len(at)))
            at = at[(at - first) % 2 == 0]
            symbols[at] = self._by_rank[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            sizes = sizes - np.bincount(owner[at], minlength=len(sizes))
            place = np.cumsum(keep) - 1
            changed = place[at]
            symbols, rank = symbols[keep], rank[keep]
            ends = np.zeros(len(symbols), bool)
            ends[np.cumsum(sizes) - 1] = True
            touched = np.union1d(changed, changed - 1)
            touched = touched[touched >= 0]
            rank[touched] = NO_RANK
            touched = touched[~ends[touched]]
            rank[touched] = self._rank(symbols[touched], symbols[touched + 1])
        return counts

    def count(self, batch: list[str]) -> list[int]:
        """The number of tokens of each text; added tokens inside it count as one each."""
        cut, extra = [], []
        for text in batch:
            parts = list(bytelevel.parts(text, self.t))
            cut.append([piece for part, token in parts if token is None for piece in bytelevel.pieces(part, self.t)])
            extra.append(sum(token is not None for _, token in parts))
        known = self.words
        new = list({piece for pieces in cut for piece in pieces if piece not in known})
        if len(known) + len(new) > KEPT_WORDS:
            known = self.words = {}
            new = list({piece for pieces in cut for piece in pieces})
        known.update(zip(new, self.count_words([piece.encode() for piece in new]).tolist(), strict=True))
        out = [more + sum(map(known.__getitem__, pieces)) for pieces, more in zip(cut, extra, strict=True)]
        for piece in new:
            if len(piece) > LONGEST_KEPT:
                del known[piece]
        return out


_COUNTERS: dict[bytes, ArrayCounter] = {}


def counter(raw: bytes) -> ArrayCounter:
    """The counter of this Python worker for a tokenizer file, given as its bytes."""
    key = hashlib.sha256(raw).digest()
    if key not in _COUNTERS:
        _COUNTERS[key] = ArrayCounter(raw)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    A null text is an empty one: no bytes, no tokens, not over the limit. Null or repeated ids are kept as they
    are, each row is counted by itself. Other columns of ``docs`` are not read.
    """
    raw = bytelevel.read_file(tokenizer)

    def run(batch: pa.RecordBatch) -> dict:
        body = bodies(batch)
        n = counter(raw).count([one.decode("utf-8", "replace") for one in body])
        return {
            "id": batch.column("id"),
            "n_bytes": pa.array(map(len, body), pa.int64()),
            "n_tokens": pa.array(n, pa.int64()),
            "over_limit": [count > limit for count in n],
        }

    rows = id_and_text(docs, id_col, text_col)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return map_slices(rows, run, schema).withColumnRenamed("id", id_col)
