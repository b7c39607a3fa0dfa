"""Byte-level BPE files: their tables, and the cut of a text into the pieces that are encoded one by one."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import regex

# The pre-tokenization pattern of this family of vocabularies.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# From here on the tables of character classes of the two libraries may be of different Unicode versions.
NEWER = re.compile("[Հ-\U0010ffff]")


def read_file(path: str) -> bytes:
    """The tokenizer file; the driver reads it once and the tasks get its bytes."""
    with open(path, "rb") as file:
        return file.read()


def _byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in such files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in set(plain)]
    return {chr(byte): byte for byte in plain} | {chr(256 + i): byte for i, byte in enumerate(others)}


@dataclass
class Tables:
    """``merges``: pair of ids to (rank, id); ``halves``: id to (rank, left, right) for merged tokens."""

    spelled: list[bytes]
    ids: dict[bytes, int]
    merges: dict[tuple[int, int], tuple[int, int]]
    halves: dict[int, tuple[int, int, int]]
    added: dict[str, int]
    raw: bytes = field(repr=False)

    @functools.cached_property
    def first_ids(self) -> list[int]:
        return [self.ids[bytes([byte])] for byte in range(256)]

    @functools.cached_property
    def added_pattern(self) -> re.Pattern | None:
        return re.compile("|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None

    @functools.cached_property
    def library_cut(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.raw.decode()).pre_tokenizer


@functools.lru_cache(maxsize=4)
def tables(raw: bytes) -> Tables:
    """Tables of a byte-level BPE file without normalizer; raises ValueError for any other kind."""
    file = json.loads(raw)
    model, cut = file["model"], file["pre_tokenizer"] or {}
    usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if model["type"] != "BPE" or file["normalizer"] or usual != {key: cut.get(key) for key in usual}:
        raise ValueError("only byte-level BPE without normalizer and prefix space can be read")
    if any(token.get(flag) for token in file["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens must be plain strings")
    byte_of = _byte_characters()
    added = {token["content"]: token["id"] for token in file["added_tokens"]}
    vocabulary = {bytes(map(byte_of.__getitem__, word)): i for word, i in model["vocab"].items() if word not in added}
    spelled = [b""] * (1 + max([*vocabulary.values(), *added.values()]))
    for word, i in vocabulary.items():
        spelled[i] = word
    for word, i in added.items():
        spelled[i] = word.encode()
    merges, halves = {}, {}
    for rank, pair in enumerate(model["merges"]):
        left, right = (bytes(map(byte_of.__getitem__, half)) for half in (pair.split(" ") if isinstance(pair, str) else pair))
        a, b, both = vocabulary[left], vocabulary[right], vocabulary[left + right]
        merges.setdefault((a, b), (rank, both))
        halves.setdefault(both, (rank, a, b))
        if a in halves and halves[a][0] > rank or b in halves and halves[b][0] > rank:
            raise ValueError("a merge comes before the merges of its halves")
    return Tables(spelled, vocabulary, merges, halves, added, raw)


def parts(text: str, t: Tables) -> Iterator[tuple[str, int | None]]:
    """The stretches between added tokens, and the added tokens with their ids."""
    if t.added_pattern is None or not any(word in text for word in t.added):
        yield text, None
        return
    end = 0
    for match in t.added_pattern.finditer(text):
        yield text[end : match.start()], None
        yield match[0], t.added[match[0]]
        end = match.end()
    yield text[end:], None


def pieces(text: str, t: Tables) -> list[str]:
    """Pre-tokens of a stretch without added tokens, in order; together they are the stretch.

    Where a text has characters whose class depends on the Unicode version, the tokenizer library cuts it.
    """
    if text.isascii() or not NEWER.search(text):
        return PIECES.findall(text)
    return [text[start:end] for _, (start, end) in t.library_cut.pre_tokenize_str(text)]
