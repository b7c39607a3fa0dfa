"""Near-duplicates by min-max hashing: candidates from banded signatures, links confirmed on full shingle sets.

Under each permutation of the shingles both the smallest and the largest value are kept, which gives two
signature values for one evaluation of a hash. Documents with the same set are one class from the start. Within
a band only links to one member, the hub, are tried first; what these links leave apart is then compared with
the other components of its bands, where bitmaps of the sets rule out nearly all pairs that are no links. So a
large group of copies costs a few pairs for each member, and no link that would join two components is lost.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.batches import bodies, id_and_text, keeps, map_slices
from ledgerline.llm.components import components
from ledgerline.session import fresh_path, write_and_read

PERMUTATIONS = 64
BAND_VALUES = 4
BITMAP_LONGS = 16
HUB_ROUNDS = 3
KEPT_WORDS = 100_000
_SEED = 20240229

_words: dict[bytes, int] = {}
keeps(__name__, _words.clear)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_words) > KEPT_WORDS:
        _words.clear()
    for word in set(words).difference(_words):
        _words[word] = xxhash.xxh3_64_intdigest(word)
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_set(body: bytes, width: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of ``width`` words.

    A-Z are lower-cased, words are what stands between blanks (0x20, 0x09 to 0x0D). Of fewer words the whole
    sequence is the one shingle; without words there is none.
    """
    hashes = _word_hashes(body.lower().split())
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - width + 1)
    mixed = np.full(n, min(len(hashes), width), np.uint64)
    for i in range(min(width, len(hashes))):
        mixed = _mixed(mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return np.unique(mixed)


def permutation_keys(n: int = PERMUTATIONS) -> np.ndarray:
    return np.random.default_rng(_SEED).integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """For each set (not empty) the minimum and the maximum under each permutation: columns min, max, min, max …"""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    every = np.concatenate(sets)
    out = np.zeros((len(sets), 2 * len(keys)), np.uint64)
    for k, key in enumerate(keys):
        values = (every ^ (key >> np.uint64(7))) * key
        values ^= values >> np.uint64(32)
        values *= key
        out[:, 2 * k] = np.minimum.reduceat(values, starts)
        out[:, 2 * k + 1] = np.maximum.reduceat(values, starts)
    return out


def band_keys(signature: np.ndarray, values: int) -> np.ndarray:
    """A 64-bit key for each band, the number of the band included; the values of a band are of different permutations."""
    n_bands = signature.shape[1] // values
    keys = np.zeros((len(signature), n_bands), np.uint64)
    for band in range(n_bands):
        group, which = divmod(band, 2)
        columns = [2 * (group * values + i) + (which ^ i & 1) for i in range(values)]
        mixed = np.full(len(signature), band + 1, np.uint64)
        for column in columns:
            mixed = _mixed(mixed * np.uint64(0x9E3779B97F4A7C15) + signature[:, column])
        keys[:, band] = mixed
    return keys


def bitmap(shingles: np.ndarray, longs: int = BITMAP_LONGS) -> np.ndarray:
    """Bits that each shingle flips, by its hash: where two bitmaps differ, so do the sets, so the number of
    differing bits is never more than that of shingles which only one of two sets has."""
    flips = np.bincount(shingles & np.uint64(64 * longs - 1), minlength=64 * longs) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def features(docs: DataFrame, width: int, permutations: int, values: int) -> DataFrame:
    """Of ``id`` and ``body``: ``id``, ``n_shingles``, ``s1`` and ``s2`` (128 bits of the set, null if empty), ``bands``, ``bits``."""
    keys = permutation_keys(permutations)

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(body, width) for body in bodies(batch)]
        full = [i for i, one in enumerate(sets) if len(one)]
        bands: list[np.ndarray | None] = [None] * len(sets)
        bits = [bitmap(one) if len(one) else None for one in sets]
        digests: list[bytes | None] = [None] * len(sets)
        at = 0
        while at < len(full):
            end, size = at, 0
            while end < len(full) and (end == at or size + len(sets[full[end]]) <= 1 << 18):
                size += len(sets[full[end]])
                end += 1
            found = band_keys(signatures([sets[i] for i in full[at:end]], keys), values).view(np.int64)
            for i, row in zip(full[at:end], found, strict=True):
                bands[i] = row
                digests[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
            at = end
        halves = [None if d is None else np.frombuffer(d, np.int64).tolist() for d in digests]
        return {
            "id": batch.column("id"),
            "n_shingles": pa.array(map(len, sets), pa.int64()),
            "s1": pa.array([h and h[0] for h in halves], pa.int64()),
            "s2": pa.array([h and h[1] for h in halves], pa.int64()),
            "bands": pa.array(bands, pa.list_(pa.int64())),
            "bits": pa.array(bits, pa.list_(pa.int64())),
        }

    return map_slices(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, n_shingles long, s1 long, s2 long, bands array<long>, bits array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """Of ``id`` and ``body``: ``id``, ``s1``, ``shingles``, the sets of the documents, eight bytes for each shingle."""

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(body, width) for body in bodies(batch)]
        first = [np.frombuffer(xxhash.xxh3_128_digest(one.tobytes()), np.int64).tolist()[0] for one in sets]
        return {"id": batch.column("id"), "s1": pa.array(first, pa.int64()), "shingles": pa.array([one.tobytes() for one in sets], pa.binary())}

    return map_slices(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, s1 long, shingles binary")


def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """The number of shingles that two sets share."""
    pairs = ((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True))
    return pd.Series([len(np.intersect1d(x, y, assume_unique=True)) for x, y in pairs], dtype="int64")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, values: int = BAND_VALUES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id``, ``n_shingles``, ``component_id``, ``kept``.

    Two documents are linked if they share at least ``percent`` of the shingles of both together; the component
    of a document is the smallest id it is linked with directly or through others, its own included, and it is
    kept if that is its own. With 64 permutations and bands of four, a pair at the threshold is missed with a
    probability of about 5e-8. Texts that are null or have no words are linked with nothing. Rows with the same
    id count as one document, their texts as linked. A row without id belongs to the component of its copies
    that have one, but links nothing; its ``kept`` is true only where it has no such copy (``component_id`` is
    then null).
    """
    spark = docs.sparkSession
    docs = id_and_text(docs, id_col, text_col)
    rows = write_and_read(features(docs, width, permutations, values), fresh_path(spark, "near-features"))
    classes = rows.where("id IS NOT NULL AND s1 IS NOT NULL").groupBy("s1", "s2").agg(F.min("id").alias("rep"))
    classes = write_and_read(classes, fresh_path(spark, "near-classes"))
    # A node is a class: the id of its first document, with the hash of the set in case that id has several texts.
    nodes = rows.join(classes.select(F.col("rep").alias("id"), "s1", "s2"), ["id", "s1", "s2"], "left_semi").dropDuplicates(["id", "s1"])
    nodes = write_and_read(nodes.select("id", "s1", F.col("n_shingles").alias("n"), "bands", *(F.get("bits", F.lit(i)).alias(f"x{i}") for i in range(BITMAP_LONGS))), fresh_path(spark, "near-nodes"))
    order = F.xxhash64("id", "s1")
    banded = nodes.select("id", "s1", F.explode("bands").alias("band"))
    buckets = banded.select("band", order.alias("h")).groupBy("band").agg(F.count("*").alias("size"), F.min("h").alias("hub_h")).where("size > 1").drop("size")
    members = write_and_read(banded.join(buckets, "band"), fresh_path(spark, "near-members"))
    signed = nodes.drop("bands")
    # Texts of one id, and of it as the first document of several classes, are one node to the links.
    same_id = rows.where("id IS NOT NULL AND s1 IS NOT NULL").join(classes, ["s1", "s2"]).where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    repeated = rows.where("s1 IS NOT NULL").groupBy("id").agg(F.count_distinct("s1", "s2").alias("texts")).where("texts > 1").select(F.col("id").alias("b"))
    links = write_and_read(same_id.join(repeated, "b", "left_semi"), fresh_path(spark, "near-same"))
    confirm = _Confirmer(docs, width, percent)

    hubs = members.where(order == F.col("hub_h")).select("band", F.struct("id", "s1").alias("hub"))
    tried = members.where(order != F.col("hub_h")).join(hubs, "band").select("id", "s1", "hub").distinct()
    hub_bits = signed.select(F.struct("id", "s1").alias("hub"), F.col("n").alias("m"), *(F.col(f"x{i}").alias(f"y{i}") for i in range(BITMAP_LONGS)))
    tried = tried.join(signed, ["id", "s1"]).join(hub_bits, "hub").where(_may_link(percent))
    links = links.unionByName(confirm(tried))
    found = components(links)
    apart = _apart(members, signed, found)
    for _ in range(HUB_ROUNDS - 1):
        if apart.isEmpty():
            break
        # The node with most links in a bucket is the likeliest original of a group: the others are tried against it.
        degrees = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
        ranked = apart.select("band", "id", "s1", "component").join(degrees, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        best = ranked.groupBy("band").agg(F.max(F.struct("degree", order.alias("h"), "id", "s1", "component")).alias("best"))
        best = best.select("band", "best.component", F.struct("best.id", "best.s1").alias("hub")).join(hub_bits, "hub").withColumnRenamed("component", "hub_component")
        tried = apart.join(best, "band").where((F.col("component") != F.col("hub_component")) & _may_link(percent))
        more = confirm(tried)
        if more.isEmpty():
            break
        links = links.unionByName(more)
        found = components(links)
        apart = _apart(members, signed, found)
    if not apart.isEmpty():
        # What is still apart is compared with every other component of its buckets; the bitmaps leave few pairs.
        other = apart.select("band", F.struct("id", "s1").alias("hub"), F.col("n").alias("m"), F.col("component").alias("hub_component"), *(F.col(f"x{i}").alias(f"y{i}") for i in range(BITMAP_LONGS)))
        rest = apart.join(other, (apart["band"] == other["band"]) & (F.col("component") < F.col("hub_component")) & _may_link(percent))
        found = components(links.unionByName(confirm(rest)))
    labelled = rows.drop("bands", "bits").join(classes, ["s1", "s2"], "left").withColumn("rep", F.coalesce("rep", "id"))
    labelled = labelled.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return labelled.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def _may_link(percent: int) -> Column:
    """Whether sets of ``n`` and ``m`` shingles can be alike enough, by their sizes and bitmaps; never wrongly false."""
    differ = reduce(add, (F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(BITMAP_LONGS)))
    both = F.col("n") + F.col("m")
    sizes = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    return sizes & ((100 + percent) * (both - differ) >= 2 * percent * both)


class _Confirmer:
    """Tells which pairs (``id``, ``s1``, ``n``; ``hub``, ``m``) are links, on the full sets of the documents in them."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs, self.width, self.percent = docs, width, percent
        self.sets: DataFrame | None = None

    def _more_sets(self, pairs: DataFrame) -> DataFrame:
        need = pairs.select("id", "s1").union(pairs.select("hub.id", "hub.s1")).distinct()
        if self.sets is not None:
            need = need.join(self.sets, ["id", "s1"], "left_anti")
        need = write_and_read(need, fresh_path(self.docs.sparkSession, "near-needed"))
        found = _sets(self.docs.join(need.select("id").distinct(), "id", "left_semi"), self.width)
        found = found.join(need, ["id", "s1"], "left_semi").dropDuplicates(["id", "s1"])
        found = write_and_read(found, fresh_path(self.docs.sparkSession, "near-sets"))
        self.sets = found if self.sets is None else self.sets.unionByName(found)
        return self.sets

    def __call__(self, pairs: DataFrame) -> DataFrame:
        spark = self.docs.sparkSession
        pairs = write_and_read(pairs.select("id", "s1", "n", "hub", "m").distinct(), fresh_path(spark, "near-pairs"))
        sets = self._more_sets(pairs)
        right = sets.select(F.struct("id", "s1").alias("hub"), F.col("shingles").alias("hub_shingles"))
        shared = pairs.join(sets, ["id", "s1"]).join(right, "hub").withColumn("common", F.pandas_udf(_common, "long")("shingles", "hub_shingles"))
        links = shared.where(100 * F.col("common") >= self.percent * (F.col("n") + F.col("m") - F.col("common")))
        return write_and_read(links.select(F.col("id").alias("a"), F.col("hub.id").alias("b")), fresh_path(spark, "near-links"))


def _apart(members: DataFrame, signed: DataFrame, found: DataFrame) -> DataFrame:
    """The members of buckets that still hold more than one component, with sizes, bitmaps and ``component``."""
    placed = members.select("band", "id", "s1").join(found.withColumnRenamed("node", "id"), "id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "id"))
    several = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("band")
    return write_and_read(placed.join(several, "band", "left_semi").join(signed, ["id", "s1"]), fresh_path(members.sparkSession, "near-apart"))


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are kept, with their columns: of each group of near-duplicates the one with the smallest id.

    Rows repeated with the id that is kept stay, so do rows without id.
    """
    gone = near_duplicates(docs, width, percent).where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
