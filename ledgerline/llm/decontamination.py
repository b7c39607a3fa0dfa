"""Benchmark decontamination: rare n-grams are joined to find the places to look at, local alignment decides.

Items of the benchmark are cut into passages of words, in tasks. A gram of a passage is a seed if it is among the
rarer ones of that passage in the corpus, counted over all documents. Seeds are joined with the grams of the
documents; where they meet, the words around are aligned with the passage by Smith-Waterman, so that copies with
words changed, left out or put in are scored too. The driver holds one filter of a fixed size and nothing else.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.batches import begin_task, keeps, map_slices, slices, texts
from ledgerline.session import fresh_path, write_and_read

WORDS = re.compile(r"\w+")
GRAM = 3
PASSAGE_WORDS = 256
LEAST_WORDS = 8
FILTER_BITS = 1 << 26
SALTS = 16
CELLS = 1 << 21
KNOWN_WORDS = 1 << 18
_MIX = 0x9E3779B97F4A7C15
FOUND = {"place": pa.int64(), "leak_key": pa.string(), "words": pa.list_(pa.int64()), "ats": pa.list_(pa.int64()), "grams": pa.list_(pa.int64())}


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return WORDS.findall(text.lower())


class WordNumbers(dict):
    """A positive, odd number for each word; what is remembered is bounded."""

    def __missing__(self, word: str) -> int:
        number = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 2 | 1
        if len(self) < KNOWN_WORDS:
            self[word] = number
        return number


_NUMBERS = WordNumbers()  # of a worker, for all its tasks
keeps(__name__, _NUMBERS.clear)


def numbers_of(found: list[list[str]]) -> np.ndarray:
    """The numbers of the words of all texts, one text after the other."""
    return np.fromiter(map(_NUMBERS.__getitem__, chain.from_iterable(found)), np.int64, sum(map(len, found)))


def gram_hashes(words: np.ndarray) -> np.ndarray:
    """A number for each run of GRAM words; fewer words make one gram together."""
    length = min(GRAM, len(words))
    if not length:
        return np.zeros(0, np.int64)
    mixed = np.full(len(words) - length + 1, length, np.uint64)
    for i in range(length):
        mixed = (mixed ^ words[i : len(words) - length + 1 + i].astype(np.uint64)) * np.uint64(_MIX)
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64)


def grams_of(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts one after the other, where each text ends, and the places and numbers of the grams."""
    found = [words_of(text) for text in batch]
    words, sizes = numbers_of(found), np.array([len(own) for own in found], np.int64)
    ends = np.cumsum(sizes)
    places = np.flatnonzero(np.repeat(ends, sizes) - np.arange(len(words)) >= GRAM)
    grams = gram_hashes(words)[places]
    short = [ends[i] - sizes[i] for i in np.flatnonzero((sizes > 0) & (sizes < GRAM))]
    whole = [gram_hashes(words[ends[i] - sizes[i] : ends[i]])[0] for i in np.flatnonzero((sizes > 0) & (sizes < GRAM))]
    places, grams = np.append(places, np.array(short, np.int64)), np.append(grams, np.array(whole, np.int64))
    order = np.argsort(places, kind="stable")
    return words, ends, places[order], grams[order]


def cut_passages(benchmark: DataFrame) -> DataFrame:
    """``passage`` (digest of its words), ``item`` (the smallest with this passage), ``words``, ``grams``."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").cast("binary").alias("body")).dropna()

    def cut(part: pa.RecordBatch) -> dict:
        owners, passages = [], []
        for item, text in zip(part.column("item").to_pylist(), texts(part), strict=True):
            words = numbers_of([words_of(text)])
            last = max(0, len(words) - PASSAGE_WORDS)
            for start in sorted({*range(0, last, PASSAGE_WORDS // 2), last}) if len(words) else ():
                owners.append(item)
                passages.append(words[start : start + PASSAGE_WORDS])
        digests = [hashlib.md5(words.tobytes()).hexdigest() for words in passages]
        grams = [gram_hashes(words) for words in passages]
        return {"passage": pa.array(digests, pa.string()), "item": pa.array(owners, pa.int64()), "words": pa.array(passages, pa.list_(pa.int64())), "grams": pa.array(grams, pa.list_(pa.int64()))}

    found = map_slices(items, cut, "passage string, item long, words array<long>, grams array<long>")
    return found.groupBy("passage").agg(F.min("item").alias("item"), F.first("words").alias("words"), F.first("grams").alias("grams"))


def gram_filter(grams: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``gram`` in 64-bit words, of FILTER_BITS however many grams there are."""
    low, high = F.col("gram").bitwiseAND(F.lit(FILTER_BITS - 1)), F.shiftrightunsigned("gram", 32).bitwiseAND(F.lit(FILTER_BITS - 1))
    bits = grams.select(F.explode(F.array(low, high)).alias("bit"))
    packed = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits"))
    rows = packed.toArrow()
    words = np.zeros(FILTER_BITS >> 6, np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return words.view(np.uint64)


def may_hold(words: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The places of ``grams`` that the filter lets through: all that are in it, and a few others."""
    places, mask = np.arange(len(grams)), np.uint64(len(words) * 64 - 1)
    for shift in (0, 32):
        bit = grams[places].view(np.uint64) >> np.uint64(shift) & mask
        places = places[(words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return places


def document_frequencies(bodies: DataFrame, grams: DataFrame) -> DataFrame:
    """``gram``, ``n``: in how many documents each of ``grams`` stands; those in none are left out."""
    known = bodies.sparkSession.sparkContext.broadcast(gram_filter(grams))

    def count(part: pa.RecordBatch) -> dict:
        _, ends, places, grams = grams_of(texts(part))
        held = may_hold(known.value, grams)
        owner, gram = np.searchsorted(ends, places[held], "right"), grams[held]
        order = np.lexsort((gram, owner))
        new = (np.diff(owner[order], prepend=-1) != 0) | (np.diff(gram[order], prepend=0) != 0)
        gram, n = np.unique(gram[order][new], return_counts=True)
        return {"gram": pa.array(gram, pa.int64()), "n": pa.array(n, pa.int64())}

    return map_slices(bodies, count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).join(grams, "gram", "left_semi")


def seeds(passages: DataFrame, frequency: DataFrame, rare_share: float) -> DataFrame:
    """``gram``, ``passage``, ``offset``, ``size``: of the places of each passage whose grams stand in documents, the
    ``rare_share`` with the rarest grams, those as rare included.

    Rarity is judged inside a passage, so one that leaked into very many documents keeps its seeds.
    """
    places = passages.select("passage", F.size("words").alias("size"), F.posexplode("grams").alias("offset", "gram")).join(frequency, "gram")
    own = Window.partitionBy("passage")  # at most PASSAGE_WORDS rows
    ranked = places.withColumn("rank", F.row_number().over(own.orderBy("n", "offset"))).withColumn("wanted", F.ceil(F.count("*").over(own) * rare_share))
    limit = F.max(F.when(F.col("rank") <= F.col("wanted"), F.col("n"))).over(own)
    return ranked.withColumn("most", limit).where("n <= most").select("gram", "passage", "offset", "size")


def texts_with_seeds(bodies: DataFrame, grams: DataFrame) -> DataFrame:
    """``place``, ``leak_key``, ``words``, ``ats``, ``grams`` of the texts that hold a gram of ``grams``, perhaps one that
    only seems to be; ``ats`` are the places of the grams among the words. A slice holds a text once."""
    known = bodies.sparkSession.sparkContext.broadcast(gram_filter(grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(__name__)
        place = TaskContext.get().partitionId() << 33

        def find(part: pa.RecordBatch) -> dict:
            nonlocal place
            own = dict(zip(part.column("leak_key").to_pylist(), texts(part), strict=True))
            keys = list(own)
            words, ends, at, grams = grams_of(list(own.values()))
            held = may_hold(known.value, grams)
            owner = np.searchsorted(ends, at[held], "right")
            rows = []
            for some in np.split(np.arange(len(held)), np.flatnonzero(np.diff(owner)) + 1) if len(held) else ():
                text = owner[some[0]]
                start = ends[text - 1] if text else 0
                rows.append((place, keys[text], words[start : ends[text]], at[held[some]] - start, grams[held[some]]))
                place += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            return {name: pa.array(values, kind) for name, values, kind in zip(FOUND, columns, FOUND.values(), strict=True)}

        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict(find(part))

    return bodies.mapInArrow(run, "place long, leak_key string, words array<long>, ats array<long>, grams array<long>")


def join_spread(many: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join on ``key`` in which the rows of a key in ``many`` are dealt to SALTS tasks by ``by``."""
    dealt = many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    copies = few.withColumn("salt", F.explode(F.array(*(F.lit(salt).cast("long") for salt in range(SALTS)))))
    return dealt.join(copies, [key, "salt"]).drop("salt")


def windows(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """``place``, ``passage``, ``low``, ``high``: the stretches of words around seeds that lie on nearby diagonals."""
    hits = found.select("place", F.explode(F.arrays_zip("ats", "grams")).alias("hit")).select("place", "hit.ats", F.col("hit.grams").alias("gram"))
    met = join_spread(hits, seeds, "gram", "place")
    lines = met.select("place", "passage", "size", (F.col("ats") - F.col("offset")).alias("diagonal")).distinct()
    along = Window.partitionBy("place", "passage").orderBy("diagonal")  # the seeds of one text
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.floor(F.col("size") / 2), F.lit(True))
    stretches = lines.withColumn("apart", apart.cast("int")).withColumn("stretch", F.sum("apart").over(along))
    slack = F.floor(F.first("size") / 2)
    ends = (F.greatest(F.min("diagonal") - slack, F.lit(0)).alias("low"), (F.max("diagonal") + F.first("size") + slack).alias("high"))
    return stretches.groupBy("place", "passage", "stretch").agg(*ends).drop("stretch")


def align(passages: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of passages against windows, word by word: match 1, mismatch -1, gap -1.

    All pairs advance together by one word of their passages; a gap along the window is a running maximum.
    """
    scores = np.zeros(len(passages), np.int32)
    order = sorted(range(len(passages)), key=lambda i: (len(passages[i]), len(windows[i])))
    at = 0
    while at < len(order):
        end, wide = at, 0
        while end < len(order) and (end == at or (end - at + 1) * max(wide, len(windows[order[end]])) <= CELLS):
            wide = max(wide, len(windows[order[end]]))
            end += 1
        group = order[at:end]
        long = max(len(passages[i]) for i in group)
        left = np.full((len(group), long), -1, np.int64)
        right = np.zeros((len(group), wide), np.int64)
        for row, i in enumerate(group):
            left[row, : len(passages[i])] = passages[i]
            right[row, : len(windows[i])] = windows[i]
        column = np.arange(wide, dtype=np.int32)
        above = np.zeros((len(group), wide + 1), np.int32)
        best = np.zeros(len(group), np.int32)
        for k in range(long):
            step = np.where(right == left[:, k : k + 1], 1, -1).astype(np.int32)
            here = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] - 1), 0)
            above[:, 1:] = np.maximum.accumulate(here + column, axis=1) - column
            np.maximum(best, above.max(axis=1), out=best)
        scores[group] = best
        at = end
    return scores


def best_matches(found: DataFrame, windows: DataFrame, passages: DataFrame) -> DataFrame:
    """``leak_key``, ``leak_item``, ``leak_score``: the item a text holds most of, the smaller id of equals."""
    near = windows.join(found.select("place", "leak_key", "words"), "place")
    near = near.select("leak_key", "passage", F.slice("words", (F.col("low") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int")).alias("window"))
    pairs = join_spread(near, passages.select("passage", "item", "words"), "passage", "leak_key")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([row.values.to_numpy() for row in batch.column(name)] for name in ("words", "window"))
            sizes = np.array([len(words) for words in left], np.int64)
            share = align(left, right) / np.maximum(sizes, 1)
            share[(sizes < LEAST_WORDS) & (share < 1)] = 0
            yield pa.RecordBatch.from_pydict({"leak_key": batch.column("leak_key"), "item": batch.column("item"), "score": pa.array(share, pa.float64())})

    scored = pairs.select("leak_key", "item", "words", "window").mapInArrow(score, "leak_key string, item long, score double").where("score > 0")
    best = scored.groupBy("leak_key").agg(F.max("score").alias("leak_score"), F.min(F.struct(-F.col("score"), F.col("item").alias("item")))["item"].alias("leak_item"))
    return best.select("leak_key", "leak_item", "leak_score")


def mark_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, rare_share: float = 0.75, text_col: str = "text") -> DataFrame:
    """``docs`` with ``leak_item`` (long), ``leak_score`` (double) and ``leaked`` (boolean).

    The score is that of the best alignment as a share of the item's (or passage's) words; from ``threshold``
    on the document counts as leaked. ``leak_item`` is the item of that alignment, null if no seed matches.
    Null and empty texts, and all texts if the benchmark is empty, have no item and score 0. Items without id
    or words are not looked for. Items of fewer than 8 words count only where all their words stand one after the
    other, those of one or two words only where they are the whole text; items of over 256 words are looked for in
    overlapping passages of that length. All rows and their other columns stay as they are, equal ones included;
    columns of ``docs`` with the new names are replaced. ``docs`` is read three times: store it first.
    """
    spark = docs.sparkSession
    key = F.md5(F.col(text_col).cast("string").cast("binary"))
    bodies = docs.select(key.alias("leak_key"), F.col(text_col).cast("string").cast("binary").alias("body"))
    passages = write_and_read(cut_passages(benchmark), fresh_path(spark, "passages"))
    grams = passages.select(F.explode("grams").alias("gram")).distinct()
    rare = write_and_read(seeds(passages, document_frequencies(bodies, grams), rare_share), fresh_path(spark, "seeds"))
    found = write_and_read(texts_with_seeds(bodies, rare.select("gram").distinct()), fresh_path(spark, "texts-with-seeds"))
    first = found.groupBy("leak_key").agg(F.min("place").alias("place")).select("place")
    found = found.join(first, "place", "left_semi")
    best = write_and_read(best_matches(found, windows(found, rare), passages), fresh_path(spark, "leaks"))
    return _with_matches(docs, key, best).withColumn("leaked", F.col("leak_score") >= threshold)


def _with_matches(docs: DataFrame, key: Column, best: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the match of their text; copies of a text are dealt to SALTS tasks."""
    kept = [name for name in docs.columns if name not in ("leak_item", "leak_score", "leaked")]
    rows = docs.select(F.struct(*(F.col(f"`{name}`") for name in kept)).alias("row"), key.alias("leak_key"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"))
    copies = best.withColumn("salt", F.explode(F.array(*(F.lit(salt).cast("long") for salt in range(SALTS)))))
    matched = rows.join(copies, ["leak_key", "salt"], "left")
    return matched.select(*(F.col("row").getField(name).alias(name) for name in kept), "leak_item", F.coalesce("leak_score", F.lit(0.0)).alias("leak_score"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, rare_share: float = 0.75) -> DataFrame:
    """The documents that hold no benchmark item, with their columns."""
    marked = mark_leaks(docs, benchmark, threshold, rare_share)
    return marked.where(~F.col("leaked")).select(*(F.col(f"`{name}`") for name in docs.columns))
