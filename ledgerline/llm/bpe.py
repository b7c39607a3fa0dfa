"""BPE encoding and decoding by prefixes: the words of a batch share one trie, and so do their encodings.

The encoding of a word is known from the last token of each of its prefixes: the token ``t`` that ends a
prefix is the one for which the rest of the prefix, encoded for itself, ends in a token that no merge of
lower rank would join with the beginning of ``t``. That state belongs to the prefix alone, so a depth-first
walk over a trie of distinct words finds it once for all words that begin alike.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm import bytelevel
from ledgerline.llm.batches import id_and_text, keeps, map_slices, texts

KEPT_WORDS = 600_000
LONGEST_KEPT = 64
KEPT_PAIRS = 500_000
SLICE_BYTES = 2 << 20  # the pieces of a slice, each an object, take some thirty times its bytes


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without the collector of cycles: there are none, and it would walk over all words kept, time and again."""
    was_on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was_on:
            gc.enable()


class TrieEncoder:
    """Encodes words (bytes) with the tables of a byte-level BPE file."""

    def __init__(self, raw: bytes):
        self.t = bytelevel.tables(raw)
        self._apart: dict[int, bool] = {}
        whole: set[int] = set()
        for token in sorted(self.t.ids.values(), key=lambda i: self.t.halves.get(i, (-1,))[0]):
            half = self.t.halves.get(token)
            if half is None and len(self.t.spelled[token]) == 1 or half and {half[1], half[2]} <= whole and not self._merged(half[1], half[2], half[0]):
                whole.add(token)
        self._steps: dict[int, int] = {}  # trie of the tokens: node * 256 + byte to node
        self._token_at = [-1]
        for token in whole:
            node = 0
            for byte in self.t.spelled[token]:
                node = self._steps.setdefault(node << 8 | byte, len(self._token_at))
                if node == len(self._token_at):
                    self._token_at.append(-1)
            self._token_at[node] = token
        self.words: dict[str, tuple[int, ...]] = {}

    def _merged(self, a: int, b: int, before: int) -> bool:
        """Would a merge of a rank below ``before`` cross the border between the tokens a and b?

        The border is followed back in time: of its two symbols, the one made last is taken apart again.
        """
        halves, merges = self.t.halves, self.t.merges
        until_a = until_b = before
        while True:
            rank = merges.get((a, b), (before,))[0]
            if rank < until_a and rank <= until_b and rank < before:
                return True
            made_a, made_b = halves.get(a), halves.get(b)
            if made_a is None and made_b is None:
                return False
            if made_b is None or made_a is not None and made_a[0] > made_b[0]:
                until_a, a = made_a[0], made_a[2]
            else:
                until_b, b = made_b[0], made_b[1]

    def _stay_apart(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if len(self._apart) > KEPT_PAIRS:
            self._apart.clear()
        apart = self._apart[key] = not self._merged(a, b, len(self.t.merges) + 1)
        return apart

    def encode_words(self, words: set[bytes]) -> dict[bytes, tuple[int, ...]]:
        """The ids of each word; what words have in common at their beginning is worked out once."""
        below: dict[int, int] = {}  # node * 256 + byte to node
        byte_of, depth_of, child, sibling = [0], [0], [0], [0]
        ends: dict[int, bytes] = {}
        for word in words:
            node = 0
            for byte in word:
                key = node << 8 | byte
                deeper = below.get(key)
                if deeper is None:
                    deeper = below[key] = len(child)
                    byte_of.append(byte)
                    depth_of.append(depth_of[node] + 1)
                    child.append(0)
                    sibling.append(child[node])
                    child[node] = deeper
                node = deeper
            ends[node] = word
        spelled, steps, token_at, apart = self.t.spelled, self._steps, self._token_at, self._apart
        found: dict[bytes, tuple[int, ...]] = {b"": ()} if b"" in words else {}
        last, begun = [-1], [()]  # by length of the prefix: its last token, and the tokens begun in it
        node = child[0]
        waiting = []
        while node:
            byte, depth = byte_of[node], depth_of[node]
            del last[depth:], begun[depth:]
            token, open_ = -1, []
            for start, inside in (*begun[-1], (depth - 1, 0)):
                inside = steps.get(inside << 8 | byte)
                if inside is None:
                    continue
                open_.append((start, inside))
                if token < 0 and (ending := token_at[inside]) >= 0:
                    if start == 0:
                        token = ending
                    else:
                        known = apart.get(last[start] << 32 | ending)
                        if known or known is None and self._stay_apart(last[start], ending):
                            token = ending
            last.append(token)
            begun.append(open_)
            if node in ends:
                ids, at = [], depth
                while at:
                    ids.append(last[at])
                    at -= len(spelled[last[at]])
                found[ends[node]] = tuple(ids[::-1])
            if sibling[node]:
                waiting.append(sibling[node])
            node = child[node] or (waiting.pop() if waiting else 0)
        return found

    @_uncollected()
    def encode(self, batch: list[str]) -> list[list[int]]:
        """The ids of each text."""
        cut = [[(bytelevel.pieces(part, self.t), None) if token is None else ((), token) for part, token in bytelevel.parts(text, self.t)] for text in batch]
        known = self.words
        new = {piece for text in cut for pieces, _ in text for piece in pieces if piece not in known}
        if len(known) + len(new) > KEPT_WORDS:
            known = self.words = {}
            new = {piece for text in cut for pieces, _ in text for piece in pieces}
        encoded = {piece: piece.encode() for piece in new}
        ids = self.encode_words(set(encoded.values()))
        known.update((piece, ids[word]) for piece, word in encoded.items())
        out = [list(chain.from_iterable(chain.from_iterable(map(known.__getitem__, pieces)) if token is None else (token,) for pieces, token in text)) for text in cut]
        for piece in new:
            if len(piece) > LONGEST_KEPT:
                del known[piece]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text that the ids spell, added tokens included."""
        return b"".join(map(self.t.spelled.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[bytes, TrieEncoder] = {}


def _give_up() -> None:
    _ENCODERS.clear()
    bytelevel.tables.cache_clear()


keeps(__name__, _give_up)


def encoder(raw: bytes) -> TrieEncoder:
    """The encoder of this Python worker for a tokenizer file, given as its bytes."""
    key = hashlib.sha256(raw).digest()
    if key not in _ENCODERS:
        _ENCODERS[key] = TrieEncoder(raw)
    return _ENCODERS[key]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``ids`` (array of int): the tokens of each whole text, no special tokens added.

    A null text is an empty one and has no tokens; ids may be null or repeated, each row is encoded by itself.
    Strings of added tokens inside a text become those tokens. Other columns of ``docs`` are not read.
    """
    raw = bytelevel.read_file(tokenizer)

    def run(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column("id"), "ids": pa.array(encoder(raw).encode(texts(batch)), pa.list_(pa.int32()))}

    rows = id_and_text(docs, id_col, text_col)
    return map_slices(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>", limit=SLICE_BYTES).withColumnRenamed("id", id_col)


def encode_and_check(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `encode`, with ``n_tokens`` and ``intact``: whether the ids decode to the text again."""
    raw = bytelevel.read_file(tokenizer)

    def run(batch: pa.RecordBatch) -> dict:
        bpe, body = encoder(raw), texts(batch)
        ids = bpe.encode(body)
        intact = [bpe.decode(one) == text for one, text in zip(ids, body, strict=True)]
        return {"id": batch.column("id"), "ids": pa.array(ids, pa.list_(pa.int32())), "n_tokens": pa.array(map(len, ids), pa.int64()), "intact": intact}

    rows = id_and_text(docs, id_col, text_col)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, n_tokens long, intact boolean"
    return map_slices(rows, run, schema, limit=SLICE_BYTES).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id``, ``text``: what the ids spell; null or no ids give the empty text. Raises for an unknown id."""
    raw = bytelevel.read_file(tokenizer)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "text": pa.array([encoder(raw).decode(ids or []) for ids in batch.column("ids").to_pylist()], pa.string())})

    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of tokens, digest of the ids, digest of what they decode to.

    Encoding and decoding follow each other in one task, so that the ids of the corpus are not moved or stored.
    """
    raw = bytelevel.read_file(tokenizer)

    def sha(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def run(batch: pa.RecordBatch) -> dict:
        bpe = encoder(raw)
        names = _decimal(len(bpe.t.spelled))
        ids = bpe.encode(texts(batch))
        return {
            "id": batch.column("id"),
            "n_tokens": pa.array(map(len, ids), pa.int64()),
            "ids_sha256": [sha(b",".join(map(names.__getitem__, one))) for one in ids],
            "decoded_sha256": [sha(bpe.decode(one).encode()) for one in ids],
        }

    rows = id_and_text(docs, id_col, text_col)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_slices(rows, run, schema, limit=SLICE_BYTES).withColumnRenamed("id", id_col)


_NAMES: dict[int, list[bytes]] = {}


def _decimal(n: int) -> list[bytes]:
    if n not in _NAMES:
        _NAMES[n] = [b"%d" % i for i in range(n)]
    return _NAMES[n]
