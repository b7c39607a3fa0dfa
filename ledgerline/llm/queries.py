"""The registered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, chunked_bpe, conversations, decontamination, line_dedup, merkle, near_dedup, neighbours, secrets, token_counts, toxicity, url_filters, warc

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"
CATEGORIES = ("low_quality", "toxic")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_novel")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.through_archives(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def labels_with_categories(labels: DataFrame) -> DataFrame:
    """The label columns in the order of the chain: whether the text is junk, then whether it is toxic."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), labels_with_categories(_table(spark, sf_dir, "labels"))
    chain = toxicity.fit(docs, labels, CATEGORIES)
    return toxicity.predict(docs, chain).select("doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=4)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def captures_and_entries(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A fetch time for each page, and an entry of one of three lists from each page, within the same 90 days.

    Host, domain or first folder of the page are listed or taken off, by its number. All pages take part.
    """
    page, start = F.col("page_id"), 1_704_067_200
    host = url_filters.host_of(F.col("url"))
    labels, folder = F.split(host, r"\."), F.regexp_extract(url_filters.path_of(F.col("url")), "^/[^/]*", 0)
    pattern = F.when(page % 3 == 0, host).when(page % 3 == 2, F.concat(host, folder)).otherwise(F.array_join(F.slice(labels, 2, F.size(labels)), "."))
    entries = pages.select(
        F.when(page % 4 == 0, "allow").when(page % 4 == 1, "spam").otherwise("adult").alias("list"),
        F.when(page % 3 == 0, "host").when(page % 3 == 1, "domain").otherwise("prefix").alias("kind"),
        pattern.alias("pattern"),
        F.when(page % 5 < 2, "add").otherwise("remove").alias("action"),
        (page * 7919 % 2160 * 3600 + start).alias("effective_at"),
    )
    return pages.select("page_id", "url", (page * 104_729 % 129_600 * 60 + start).alias("fetched_at")), entries


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, entries = captures_and_entries(_table(spark, sf_dir, "pages"))
    return url_filters.evaluate(captures, entries, allow_lists=["allow"])


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.clean(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontamination.mark_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "leak_item", "leak_score", "leaked")


def op11_byte_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    asked = rows.select(F.col("conv_id").alias("conv")).distinct()
    return conversations.reports(conversations.repair(conversations.damage(rows), asked)).withColumnRenamed("conv", "conv_id")


def leaves_and_tampered(docs: DataFrame) -> DataFrame:
    """Each document's leaf, and the leaf it would be if its count of characters were one higher, where that was tampered with."""
    count = F.col("n_chars")
    leaf, other = (merkle.digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")) for n in (count, F.try_add(count, F.lit(1))))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, other).otherwise(leaf)
    return docs.select("doc_id", "lang", leaf.alias("leaf"), tampered.alias("tampered"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = merkle.build(leaves_and_tampered(_table(spark, sf_dir, "documents")), "lang", "doc_id", "leaf")
    proofs = merkle.fold(merkle.prove(manifest), "tampered")
    proof = F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256")
    return proofs.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {query.__name__: query for query in (op1_secret_scans, op2_warc, op3_toxicity, op4_minhash_near_dedup, op5_bpe_round_trip, op6_token_counts, op7_url_filters, op8_nearest_neighbours, op9_line_dedup, op10_decontamination, op11_byte_bpe_chunks, op12_conversation_repair, op13_merkle_manifest)}

# 160 bits of the digest in 32 letters of five bits each: letter i begins in the hex digit i * 5 / 4.
_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(sha1(payload) || '0', 1 + (i * 5) // 4, 2))::INTEGER >> (3 - (i * 5) % 4)) & 31), 1)), '')"""

# CRC-32 of the digits of a number, bit by bit.
_CRC32 = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), list_transform(range(8), lambda i: 0::UBIGINT)), lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1::UBIGINT)))))"""


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(name) for name in ("doc_id", "source", "lang", n_chars, "text")) + ")"


ORACLES = {
    "op2_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
        SELECT page_id, strlen(payload) AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to, TRUE AS verified
        FROM f""",
    "op7_url_filters": r"""
        WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
                          coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?[^/?#:]*(?::[0-9]*)?([^?#]*)', 1), ''), '/') AS path,
                          page_id * 104729 % 129600 * 60 + 1704067200 AS seconds FROM pages),
             e AS (SELECT CASE page_id % 4 WHEN 0 THEN 'allow' WHEN 1 THEN 'spam' ELSE 'adult' END AS list,
                          CASE page_id % 3 WHEN 0 THEN 'host' WHEN 1 THEN 'domain' ELSE 'prefix' END AS kind,
                          CASE page_id % 3 WHEN 0 THEN host WHEN 2 THEN host || regexp_extract(path, '^/[^/]*', 0)
                               ELSE array_to_string(string_split(host, '.')[2:], '.') END AS pattern,
                          page_id % 5 < 2 AS added, page_id * 7919 % 2160 * 3600 + 1704067200 AS seconds FROM p),
             s AS (SELECT list, kind, pattern, seconds, max(added) AS added FROM e GROUP BY ALL),
             i AS (SELECT *, lead(seconds) OVER (PARTITION BY list, kind, pattern ORDER BY seconds) AS until FROM s),
             d AS (SELECT page_id, 'domain' AS kind, array_to_string(string_split(host, '.')[unnest(range(1, len(string_split(host, '.')) + 1)):], '.') AS pattern FROM p),
             f AS (SELECT page_id, 'prefix' AS kind, host || array_to_string(string_split(path, '/')[1:unnest(range(1, greatest(len(string_split(path, '/')) - 1, 1) + 1))], '/') || '/' AS pattern FROM p),
             k AS (SELECT page_id, 'host' AS kind, host AS pattern FROM p UNION SELECT * FROM d UNION SELECT * FROM f
                   UNION SELECT page_id, 'prefix', host || path FROM p),
             a AS (SELECT p.page_id, i.list FROM p JOIN k USING (page_id) JOIN i USING (kind, pattern)
                   WHERE added AND i.seconds <= p.seconds AND (until IS NULL OR p.seconds < until)),
             c AS (SELECT page_id, count(*) AS n_active, bool_or(list = 'allow') AS allowed, bool_or(list <> 'allow') AS listed FROM a GROUP BY page_id)
        SELECT p.page_id, url, seconds, coalesce(n_active, 0) AS n_active, coalesce(allowed, FALSE) AS allowed,
               coalesce(listed, FALSE) AND NOT coalesce(allowed, FALSE) AS blocked
        FROM p LEFT JOIN c USING (page_id)""",
    "op9_line_dedup": f"""
        WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
                   FROM documents),
             k AS (SELECT *, lower(trim(regexp_replace(line, '[ \\t\\r\\f\\v]+', ' ', 'g'))) AS key FROM l),
             b AS (SELECT key, min({{'doc_id': doc_id, 'pos': pos}}) AS first FROM k WHERE key <> ''
                   GROUP BY key HAVING count(DISTINCT source) >= {line_dedup.LEAST_SITES}),
             m AS (SELECT k.*, b.key IS NOT NULL AND (b.first.doc_id <> k.doc_id OR b.first.pos <> k.pos) AS goes
                   FROM k LEFT JOIN b ON k.key = b.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS text_sha256
        FROM m GROUP BY doc_id""",
    "op13_merkle_manifest": f"""
        WITH RECURSIVE
             d AS (SELECT doc_id, coalesce('+' || lang, '') AS tree, {_leaf("n_chars")} AS leaf,
                          CASE WHEN {_CRC32} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS tampered FROM documents),
             p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
             nodes AS (SELECT tree, 0 AS level, place, leaf AS hash, count(*) OVER (PARTITION BY tree) AS n FROM p
                       UNION ALL
                       SELECT tree, level + 1, place // 2, sha256(hash || behind), (n + 1) // 2
                       FROM (SELECT *, coalesce(lead(hash) OVER (PARTITION BY tree ORDER BY place), '') AS behind FROM nodes WHERE n > 1)
                       WHERE place % 2 = 0),
             subroots AS (SELECT tree, level AS height, hash AS subroot FROM nodes WHERE n = 1),
             trees AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS number FROM subroots),
             upper AS (SELECT 0 AS level, number AS place, subroot AS hash, count(*) OVER () AS n FROM trees
                       UNION ALL
                       SELECT level + 1, place // 2, sha256(hash || behind), (n + 1) // 2
                       FROM (SELECT *, coalesce(lead(hash) OVER (ORDER BY place), '') AS behind FROM upper WHERE n > 1)
                       WHERE place % 2 = 0),
             top AS (SELECT hash AS root FROM upper WHERE n = 1),
             steps AS (SELECT p.tree, p.place AS leaf_place, s.level AS step, s.hash, (p.place >> s.level) % 2 AS side
                       FROM p JOIN nodes s ON s.tree = p.tree AND s.n > 1 AND s.place = xor(p.place >> s.level, 1)
                       UNION ALL
                       SELECT p.tree, p.place, t.height + s.level, s.hash, (t.number >> s.level) % 2
                       FROM p JOIN trees t ON t.tree = p.tree JOIN upper s ON s.n > 1 AND s.place = xor(t.number >> s.level, 1)),
             heights AS (SELECT tree, height + (SELECT max(level) FROM upper) AS height FROM trees),
             folds AS (SELECT p.tree, p.place, 0 AS step, tampered AS hash FROM p
                       UNION ALL
                       SELECT f.tree, f.place, f.step + 1,
                              sha256(CASE WHEN s.hash IS NULL THEN f.hash WHEN s.side = 0 THEN f.hash || s.hash ELSE s.hash || f.hash END)
                       FROM folds f JOIN heights h ON h.tree = f.tree AND f.step < h.height
                            LEFT JOIN steps s ON s.tree = f.tree AND s.leaf_place = f.place AND s.step = f.step),
             proofs AS (SELECT tree, leaf_place AS place, sha256(string_agg(hash, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY ALL)
        SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.hash AS folded_root, f.hash = root AS verified
        FROM p JOIN trees t USING (tree) CROSS JOIN top LEFT JOIN proofs USING (tree, place)
             JOIN heights h USING (tree) JOIN folds f ON f.tree = p.tree AND f.place = p.place AND f.step = h.height""",
}
