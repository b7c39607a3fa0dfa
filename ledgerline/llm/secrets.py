"""Secret scans: fixed patterns, and strings that a primed compressor cannot foresee."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.batches import bodies, id_and_text, map_slices, slices

# The base patterns and the lengths that they must reach.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
KINDS = ("assign", "access", "hex", "novel")

# A text without a match of this has no base span. What follows reads only the texts that have one.
ANY_BASE = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]|[0-9a-f]{16}"
ANNOUNCING = r"(?ai:pass(?:word|wd|phrase)|pwd|secret|token|api[_ -]?key|credential|private[_ -]?key|access[_ -]?key|auth(?:orization)?|bearer)"
ANNOUNCED = re.compile(ANNOUNCING)
RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}")
TIED = re.compile(ANNOUNCING + r"[A-Za-z0-9_.-]*=+([A-Za-z0-9+/_.-][A-Za-z0-9+/_.=-]{11,})")
ANY_SENSITIVE = r"(?i:passphrase|pwd|credential|private[_ -]?key|access[_ -]?key|auth|bearer|password|passwd|secret|token|api[_ -]?key)"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{3,63}"

# Identifiers of code that the dictionary holds besides those of the corpus.
CODE = "import return function const class public private static string value config settings default username password secret token api_key access_key private_key client_id client_secret authorization bearer connection host port database environment example changeme placeholder undefined null true false"


def identifier_counts(docs: DataFrame, text_col: str = "text", having: str | None = ANY_SENSITIVE) -> DataFrame:
    """``word``, ``n_docs``: in how many texts each identifier stands, of those that match ``having`` or, if None, of all.

    By default these are the texts with a word that announces a secret. Counts are added up inside each task first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        find = re.compile(IDENTIFIER, re.ASCII).findall
        for batch in batches:
            for part in slices(batch):
                for body in bodies(part) if having is None else _having(part, having):
                    counts.update(set(find(body.decode("utf-8", "replace"))))
                    if len(counts) > 200_000:
                        yield _counted(counts)
                        counts.clear()
        yield _counted(counts)

    rows = docs.select(F.col(text_col).cast("string").cast("binary").alias("body"))
    return rows.mapInArrow(run, "word string, n_docs long").groupBy("word").agg(F.sum("n_docs").alias("n_docs"))


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"word": pa.array(counts.keys(), pa.string()), "n_docs": pa.array(counts.values(), pa.int64())})


def _having(batch: pa.RecordBatch, pattern: str) -> list[bytes]:
    column = batch.column("body")
    return column.filter(pc.match_substring_regex(column, pattern)).to_pylist()


def identifier_dictionary(docs: DataFrame, text_col: str = "text", size: int = 1024) -> bytes:
    """The dictionary that primes the compressor: the ``size`` identifiers of most texts, the most common last.

    It has at most ``size`` words of at most 64 characters, so what comes to the driver is bounded. All texts
    are counted; ties go to the word that is first in alphabetical order.
    """
    top = identifier_counts(docs, text_col, having=None).where("n_docs > 1").orderBy(F.desc("n_docs"), "word").limit(size).collect()
    return " ".join([CODE, *(row["word"] for row in reversed(top))]).encode()


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Where strings of 12 or more characters stand behind an announcing word of their line, in order.

    What a ``=`` ties to the word, or to a name with it, is a candidate by itself, unless the whole is one by an earlier word.
    """
    searched = 0
    for word in ANNOUNCED.finditer(text):
        if word.start() < searched:
            continue
        line_end = text.find("\n", word.end())
        line_end = len(text) if line_end < 0 else line_end
        if tied := TIED.match(text, word.start(), line_end):
            yield tied.span(1)
        yield from (run.span() for run in RUN.finditer(text, word.end(), line_end))
        searched = line_end


class NoveltyScanner:
    """Finds the spans of a text: ``(start, end, kind)`` in code points.

    A candidate is a string of 12 or more characters that follows a word announcing a secret in the same line,
    at any distance: all strings of a line are measured, one by one, but for those that overlap a base span.
    Its novelty is what it adds to the compressed size of its surroundings, a compressor primed with the
    dictionary being used, per byte. It is reported from ``novelty`` on if it mixes letters and digits or cases;
    words of a language and paths seen elsewhere compress, keys do not.
    """

    def __init__(self, dictionary: bytes, novelty: float = 0.8, window: int = 512):
        self.novelty, self.window = novelty, window
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_dict_id=False)

    def marginal_bytes(self, text: str, start: int, end: int) -> int:
        """By how many bytes the candidate makes its compressed surroundings longer."""
        before, after = text[max(0, start - self.window) : start], text[end : end + self.window]
        around = (after + "\n" + before).encode("utf-8", "replace")
        size = len(self.compressor.compress(around))
        return len(self.compressor.compress(around + text[start:end].encode())) - size

    def base(self, text: str) -> list[tuple[int, int, str]]:
        found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
        found += [(*m.span(), "hex") for m in HEX.finditer(text)]
        return sorted(found, key=lambda span: (span[0], KINDS.index(span[2])))

    def novel(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        found = []
        starts, reach = [span[0] for span in base], list(accumulate((span[1] for span in base), max))
        for start, end in candidates(text):
            word = text[start:end]
            mixed = any(c.isdigit() for c in word) and any(c.isalpha() for c in word)
            mixed |= any(c.isupper() for c in word[1:]) and any(c.islower() for c in word)
            before = bisect_left(starts, end)
            if mixed and not (before and reach[before - 1] > start) and self.marginal_bytes(text, start, end) >= self.novelty * (end - start):
                found.append((start, end, "novel"))
        return found

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        base = self.base(text)
        return sorted(base + self.novel(text, base), key=lambda span: (span[0], KINDS.index(span[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", novelty: float = 0.8, dictionary: bytes | None = None) -> DataFrame:
    """Per row: ``n_assign``, ``n_access``, ``n_hex``, ``n_novel``, ``base`` and ``spans``, the last two as text.

    Whole texts are read. A null or empty text has no spans; ids may be null or repeated, each row is scanned
    by itself; other columns are not read. Patterns match on ASCII letters only. Without ``dictionary`` that of
    the given texts is made first, over all of them.
    """
    primed = identifier_dictionary(docs, text_col) if dictionary is None else dictionary

    def run(batch: pa.RecordBatch) -> dict:
        scanner = NoveltyScanner(primed, novelty)
        column = batch.column("body")
        likely = pc.fill_null(pc.or_(pc.match_substring_regex(column, ANY_BASE), pc.match_substring_regex(column, ANY_SENSITIVE)), False).to_pylist()
        found = [scanner.spans(body.decode("utf-8", "replace")) if look else [] for body, look in zip(bodies(batch), likely, strict=True)]
        counts = {f"n_{kind}": pa.array([sum(span[2] == kind for span in spans) for spans in found], pa.int64()) for kind in KINDS}
        base = [joined([span for span in spans if span[2] != "novel"]) for spans in found]
        return {"id": batch.column("id"), **counts, "base": base, "spans": [joined(spans) for spans in found]}

    rows = id_and_text(docs, id_col, text_col)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_novel long, base string, spans string"
    return map_slices(rows, run, schema).withColumnRenamed("id", id_col)
