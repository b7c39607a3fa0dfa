"""Byte-level BPE by ranks, of texts cut into overlapping chunks.

A long text becomes chunks that overlap, and tasks cut them into pre-tokens side by side. What a pattern matches from a
place on depends on the text behind it alone; so where two neighbouring chunks both begin a pre-token at the same place
of their overlap, they agree from there on. The chunks are stitched at the first such places, and each task encodes the
pieces between its two. Where an overlap has no such place, because one pre-token spans it, the text is cut anew as a
whole, in a stream. Decoding joins the bytes of the tokens.

The pattern must take every character, look behind no match's beginning, and see at most two characters behind its end.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.batches import id_and_text, slices, texts
from ledgerline.session import fresh_path, write_and_read

CHUNK = 32_768  # characters from the beginning of a chunk to that of the next
OVERLAP = 512  # characters that a chunk shares with the next
LOOK_AHEAD = 2  # characters behind a pre-token that must be seen before it is sure to end there
SLICE = 2 << 20  # bytes of texts whose pre-tokens are held at a time
PIECES = 50_000  # pre-tokens that are held at a time
KEPT_WORDS = 250_000
LONGEST_KEPT = 32
SHORT = 128  # bytes of the longest piece that is joined together with others
NO_RANK = 1 << 30


def read_ranks(path: str) -> bytes:
    """The rank file; the driver reads it once and the tasks get its bytes."""
    with open(path, "rb") as file:
        return file.read()


@functools.lru_cache(maxsize=4)
def _ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


@dataclass(frozen=True)
class Cutter:
    """A pattern with its classes spelled out as ranges: ``narrow`` with those up to U+FFFF, for texts without characters
    beyond, ``full`` with all of them."""

    narrow: str
    full: str

    def pattern_for(self, text: str) -> re.Pattern:
        return _compiled(self.narrow if text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text) else self.full)


_compiled = functools.lru_cache(maxsize=8)(re.compile)


def _ranges(characters: Sequence[str], last: int) -> str:
    out: list[list[int]] = []
    for point in map(ord, characters):
        if point > last:
            break
        if out and out[-1][1] == point - 1:
            out[-1][1] = point
        else:
            out.append([point, point])
    return "".join(f"\\U{low:08x}-\\U{high:08x}" for low, high in out)


@functools.lru_cache(maxsize=4)
def cutter(pattern: str) -> Cutter:
    """The cutter for ``pattern``, with the classes of letters, numbers and blanks that the library knows.

    The library keeps what its pattern matches and drops the rest; with single bytes as tokens it so tells which
    characters a class has, whatever version of Unicode it follows.
    """
    single = {bytes([byte]): byte for byte in range(256)}
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    members = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        library = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        members[name] = sorted(set(library.decode(library.encode_ordinary(every))))

    def spelled_out(last: int) -> str:
        ranges = {name: _ranges(characters, last) for name, characters in members.items()}
        out, inside = [], False
        for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.DOTALL):
            inside = part == "[" or inside and part != "]"
            if part in ranges:
                part = ranges[part] if inside else f"[{ranges[part]}]"
            elif part == r"\S" and not inside:
                part = f"[^{ranges[r'\s']}]"
            elif part[0] == "\\" and part[1:2].isalpha():
                raise ValueError(f"{part} is not known here")
            out.append(part)
        return "".join(out)

    return Cutter(spelled_out(0xFFFF), spelled_out(0x10FFFF))


class RankEncoder:
    """Encodes texts by the ranks of a file; every piece is encoded by itself."""

    def __init__(self, raw: bytes, cut: Cutter):
        self.ranks, self.cut = _ranks(raw), cut
        spelled = [b""] * (1 + max(self.ranks.values()))
        for token, rank in self.ranks.items():
            spelled[rank] = token
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.sizes = np.array([len(token) for token in spelled], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words: dict[str, bytes] = {}
        pairs = {}
        for token, rank in self.ranks.items():
            for cut_at in range(1, len(token)):
                first, second = self.ranks.get(token[:cut_at]), self.ranks.get(token[cut_at:])
                if first is not None and second is not None:
                    pairs[first << 32 | second] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[key] for key in self.pairs.tolist()], np.int64)
        self.of_byte = np.array([self.ranks[bytes([byte])] for byte in range(256)], np.int64)
        self.byte_pairs = np.array([[self.ranks.get(bytes([a, b]), NO_RANK) for b in range(256)] for a in range(256)], np.int64)

    def rank_of_pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys = first << 32 | second
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.joined[at], NO_RANK)

    def encode_words(self, words: Sequence[bytes]) -> list[bytes]:
        """The packed ids of short pieces. All have their next pair joined at the same time: of the pairs of a piece the one
        of the lowest rank, and of these the leftmost."""
        sizes = np.array([len(word) for word in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.of_byte[raw]
        word = np.repeat(np.arange(len(words)), sizes)
        ranks = np.full(len(symbols), NO_RANK)  # of each symbol with the one behind it
        ranks[:-1] = np.where(word[1:] == word[:-1], self.byte_pairs[raw[:-1], raw[1:]], NO_RANK)
        done_words, done_symbols = [], []
        while len(symbols):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            lowest = np.minimum.reduceat(ranks << 32 | np.arange(len(symbols)), starts)
            rank, at = lowest >> 32, lowest & 0xFFFFFFFF
            going = rank < NO_RANK
            keep = np.repeat(going, np.diff(starts, append=len(symbols)))
            done_words.append(word[~keep])
            done_symbols.append(symbols[~keep])
            rank, at = rank[going], at[going]
            symbols[at] = rank
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, word, ranks, at = symbols[keep], word[keep], ranks[keep], moved[at]
            for left in (at, at - 1):
                ok = (left >= 0) & (left + 1 < len(symbols))
                ok[ok] = word[left[ok]] == word[left[ok] + 1]
                ranks[left[~ok & (left >= 0)]] = NO_RANK
                left = left[ok]
                ranks[left] = self.rank_of_pairs(symbols[left], symbols[left + 1])
        order = np.concatenate(done_words)
        place = np.argsort(order, kind="stable")
        packed = np.concatenate(done_symbols)[place].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(order, minlength=len(words)))).tolist()
        return [packed[start:end] for start, end in zip([0, *ends], ends, strict=False)]

    def encode_piece(self, piece: bytes) -> bytes:
        rank = self.ranks.get(piece)
        ids = self.by_heap(piece) if rank is None else [rank]
        return struct.pack(f"<{len(ids)}I", *ids)

    def by_heap(self, piece: bytes) -> list[int]:
        """The ids of one piece, in a time that grows little faster than the piece, however long it is."""
        ranks = self.ranks
        size = len(piece)
        behind, before = list(range(1, size + 2)), list(range(-1, size))  # by the first byte of a symbol: its neighbours
        rank_of = [ranks.get(piece[i : i + 2], -1) for i in range(size - 1)] + [-1]  # of a symbol with the next one
        waiting = [rank << 40 | i for i, rank in enumerate(rank_of) if rank >= 0]
        heapq.heapify(waiting)
        while waiting:
            first = heapq.heappop(waiting)
            rank, at = first >> 40, first & 0xFFFFFFFFFF
            if rank_of[at] != rank:
                continue  # one of the two has been joined with another since
            gone = behind[at]
            rank_of[gone] = -1
            after = behind[at] = behind[gone]
            if after < size:
                before[after] = at
            for left in (at, before[at]):
                if left < 0:
                    continue
                right = behind[left]
                rank = ranks.get(piece[left : behind[right]], -1) if right < size else -1
                rank_of[left] = rank
                if rank >= 0:
                    heapq.heappush(waiting, rank << 40 | left)
        out, at = [], 0
        while at < size:
            out.append(ranks[piece[at : behind[at]]])
            at = behind[at]
        return out

    def encode_pieces(self, cut: Sequence[Sequence[str]]) -> list[bytes]:
        """The ids of the pieces of several texts, as little-endian 32-bit integers."""
        get = self.words.get
        found = [list(map(get, pieces)) for pieces in cut]
        holes = [[i for i, ids in enumerate(of_text) if ids is None] for of_text in found]
        new = list({pieces[i] for pieces, at in zip(cut, holes, strict=True) for i in at})
        spelled = [piece.encode() for piece in new]
        ids_of = {piece: self.encode_piece(word) for piece, word in zip(new, spelled, strict=True) if len(word) > SHORT or word in self.ranks}
        others = [(piece, word) for piece, word in zip(new, spelled, strict=True) if piece not in ids_of]
        if others:
            ids_of.update(zip([piece for piece, _ in others], self.encode_words([word for _, word in others]), strict=True))
        for pieces, of_text, at in zip(cut, found, holes, strict=True):
            for i in at:
                of_text[i] = ids_of[pieces[i]]
        if len(self.words) + len(ids_of) > KEPT_WORDS:
            self.words.clear()
        self.words.update((piece, ids) for piece, ids in islice(ids_of.items(), KEPT_WORDS) if len(piece) <= LONGEST_KEPT)
        return list(map(b"".join, found))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of whole texts; the pre-tokens of a long one are not held all at a time."""
        out: list[bytes] = []
        held: list[list[str]] = []
        for text in texts:
            pattern = self.cut.pattern_for(text)
            if len(text) <= CHUNK + OVERLAP:
                held.append(pattern.findall(text))
                continue
            out += self.encode_pieces(held)
            held = []
            pieces = (match[0] for match in pattern.finditer(text))
            out.append(b"".join(iter(lambda: self.encode_pieces([list(islice(pieces, PIECES))])[0], b"")))  # noqa: B023
        return out + self.encode_pieces(held)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the tokens, joined; raises for an id that is none."""
        out = []
        for start in range(0, len(ids), 4 * PIECES):
            tokens = np.frombuffer(ids[start : start + 4 * PIECES], "<u4")
            sizes = self.sizes[tokens]
            ends = np.cumsum(sizes)
            out.append(self.bytes[np.arange(ends[-1]) + np.repeat(self.starts[tokens] - ends + sizes, sizes)].tobytes())
        return b"".join(out)


def boundaries(text: str, cut: Cutter, last: bool) -> list[int]:
    """Where pre-tokens of a chunk begin, as far as they do not depend on what is behind the chunk."""
    pieces = cut.pattern_for(text).findall(text)
    ends = list(accumulate(map(len, pieces), initial=0))
    if ends[-1] != len(text):
        raise ValueError("the pattern must take every character")
    while not last and ends[-1] + LOOK_AHEAD > len(text) and len(ends) > 1:
        ends.pop()
    return ends


_ENCODERS: dict[tuple[bytes, Cutter], RankEncoder] = {}


def encoder(raw: bytes, cut: Cutter) -> RankEncoder:
    """The encoder of this Python worker."""
    key = hashlib.sha256(raw).digest(), cut
    if key not in _ENCODERS:
        _ENCODERS[key] = RankEncoder(raw, cut)
    return _ENCODERS[key]


def _map_texts(df: DataFrame, function: Callable[[pa.RecordBatch, list[str]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                yield from function(part, texts(part))

    return df.mapInArrow(run, schema)


def _encoded(docs: DataFrame, ranks: str, pattern: str, finish: Callable[[RankEncoder, list[bytes]], dict[str, pa.Array]], results: str, id_col: str, text_col: str, chunk: int, overlap: int) -> DataFrame:
    """The ids of each row's text, as packed bytes, turned into the columns ``results`` by ``finish``, in a task."""
    spark = docs.sparkSession
    if not LOOK_AHEAD < overlap < chunk:
        raise ValueError("the overlap must be smaller than a chunk")
    raw, cut = read_ranks(ranks), cutter(pattern)
    read = docs.select(F.col(id_col).alias("id"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"))
    one_chunk = F.coalesce(F.length("text"), F.lit(0)) <= chunk + overlap
    body = F.col("text").cast("binary").alias("body")
    finished = T.StructType([read.schema["id"], *T.StructType.fromDDL(results)])

    def out(ids: pa.Array, packed: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"id": ids, **finish(encoder(raw, cut), packed)})

    def whole(part: pa.RecordBatch, read: list[str]) -> Iterator[pa.RecordBatch]:
        yield out(part.column("id"), encoder(raw, cut).encode(read))

    short = _map_texts(read.where(one_chunk).select("id", body), whole, finished)
    long_ones = write_and_read(read.where(~one_chunk).withColumn("row", F.monotonically_increasing_id()), fresh_path(spark, "long-texts"))
    if long_ones.isEmpty():
        return short

    def cut_up(part: pa.RecordBatch, read: list[str]) -> Iterator[pa.RecordBatch]:
        for i, text in enumerate(read):
            starts = range(0, max(1, len(text) - overlap), chunk)
            for first in range(0, len(starts), 64):
                own = starts[first : first + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column("id")[i].as_py()] * len(own), part.schema.field("id").type), pa.array([part.column("row")[i].as_py()] * len(own), pa.int64()), pa.array(range(first, first + len(own)), pa.int64()),
                     pa.array([start == starts[-1] for start in own]), pa.array([text[start : start + chunk + overlap].encode() for start in own], pa.binary())],
                    names=["id", "row", "k", "last", "body"],
                )

    chunks = _map_texts(long_ones.select("id", "row", body), cut_up, T.StructType([read.schema["id"], *T.StructType.fromDDL("row long, k long, last boolean, body binary")]))

    def borders(part: pa.RecordBatch, read: list[str]) -> Iterator[pa.RecordBatch]:
        heads, tails = [], []
        for text, last in zip(read, part.column("last").to_pylist(), strict=True):
            found = boundaries(text, cut, last)
            heads.append([at for at in found if at <= overlap])
            tails.append([at - chunk for at in found if at >= chunk])
        yield pa.RecordBatch.from_arrays([part.column("row"), part.column("k"), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], names=["row", "k", "heads", "tails"])

    seen = _map_texts(chunks.select("row", "k", "last", "body").repartition("row", "k"), borders, T.StructType.fromDDL("row long, k long, heads array<int>, tails array<int>"))
    of_row = Window.partitionBy("row")
    agreed = F.array_min(F.array_intersect(F.lag("tails").over(of_row.orderBy("k")), "heads"))
    stitches = seen.select("row", "k", F.when(F.col("k") == 0, 0).otherwise(agreed).alias("start"))
    stitches = stitches.withColumn("stitched", F.count("start").over(of_row) == F.count(F.lit(1)).over(of_row)).withColumn("end", chunk + F.lead("start").over(of_row.orderBy("k")))
    stitches = write_and_read(stitches, fresh_path(spark, "stitches"))
    apart = long_ones.join(stitches.where(~F.col("stitched")).select("row").distinct(), "row", "left_semi")

    def pieces(part: pa.RecordBatch, read: list[str]) -> Iterator[pa.RecordBatch]:
        packed = encoder(raw, cut).encode([text[start:end] for text, start, end in zip(read, part.column("start").to_pylist(), part.column("end").to_pylist(), strict=True)])
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "row", "k")), pa.array(packed, pa.binary())], names=["id", "row", "k", "packed"])

    stitched = chunks.join(stitches.where("stitched").select("row", "k", "start", "end"), ["row", "k"]).select("id", "row", "k", "start", "end", "body")
    encoded = _map_texts(stitched, pieces, T.StructType([read.schema["id"], *T.StructType.fromDDL("row long, k long, packed binary")]))
    joined = encoded.groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("k", "packed"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield out(batch.column("id").slice(i, 1), [b"".join(part["packed"] for part in batch.column("parts")[i].as_py())])

    return short.unionByName(_map_texts(apart.select("id", body), whole, finished)).unionByName(joined.select("id", "parts").mapInArrow(join, finished))


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``id``, ``ids`` (array of int): the tokens of each whole text, without special tokens.

    A null text is an empty one and has no tokens; ids may be null or repeated, each row is encoded by itself. Bytes
    that are not UTF-8 become replacement characters. Other columns of ``docs`` are not read.
    """

    def finish(_: RankEncoder, packed: list[bytes]) -> dict[str, pa.Array]:
        return {"ids": pa.array([np.frombuffer(one, "<i4") for one in packed], pa.list_(pa.int32()))}

    return _encoded(docs, ranks, pattern, finish, "ids array<int>", id_col, text_col, chunk, overlap).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, ranks: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id``, ``decoded`` (binary): the bytes of the tokens, joined; nothing for null or no ids. Raises for an unknown id."""
    raw = read_ranks(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(raw, Cutter("", ""))
        for batch in batches:
            decoded = [own.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "decoded": pa.array(decoded, pa.binary())})

    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("decoded", T.BinaryType())])).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row: number of tokens, digest of the ids as little-endian 32-bit integers, digest of the bytes they decode to.

    Rows are taken as by `encode`. Decoding follows in the task that has all ids of a text, so they are not stored.
    """

    def finish(own: RankEncoder, packed: list[bytes]) -> dict[str, pa.Array]:
        return {
            "n_tokens": pa.array([len(one) // 4 for one in packed], pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(one).hexdigest() for one in packed]),
            "decoded_sha256": pa.array([hashlib.sha256(own.decode(one)).hexdigest() for one in packed]),
        }

    return _encoded(docs, ranks, pattern, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col, chunk, overlap).withColumnRenamed("id", id_col)
