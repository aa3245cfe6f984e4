"""BPE encoding and decoding (op11) with a contiguous rank array.

A text is parted at the vocabulary's special tokens and by its pattern into words. A word is an array of parts, one for
each byte at first, where an entry stands for the boundary that its part begins at, beside an array of the ranks of adjacent parts. The least
rank is looked for by a scan, the boundary between its two parts is deleted, and the ranks on both sides are made anew. For short words that is
faster than any heap; a word of more than ``SHORT`` bytes, where scans would cost the square of its length, has a heap and the same result.

Each word is merged once in a task's cache, so the cost of the merges follows the number of different words. Nothing is
shuffled. Encoding and decoding are columns of Arrow batches: a task holds one portion of texts and their ids.
"""

from __future__ import annotations

import array
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import quoted
from .words import portions

#: The pattern of byte-level BPE's words, from classes of letters, numbers, and all but these and white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\s+(?!\S)|\s+"
#: Bytes of a word that is merged by scans.
SHORT = 256
#: Words that a task remembers, and how long the longest of them may be.
CACHED, REMEMBERED = 600_000, 64
#: Characters of a text that are parted into words at once, about.
PART = 1 << 20


def alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if it shows, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def unlike() -> frozenset[str]:
    """Characters that are letters or numbers here and neither in the tokenizers library, which knows an earlier Unicode: of those that Python's own, still earlier, does not know."""
    from tokenizers.pre_tokenizers import ByteLevel

    parted = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    late = [x for x in map(chr, range(0x110000)) if unicodedata.category(x) == "Cn"]
    letter, number = (regex.compile(x).match for x in (r"\p{L}", r"\p{N}"))
    return frozenset(x for x in late if (letter(x) and len(parted("a" + x)) > 1) or (number(x) and len(parted("1" + x)) > 1))


class Bpe(dict):
    """A byte-level BPE vocabulary file of the tokenizers library. As a dict: a word's ids, as 32-bit integers in bytes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = {"dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False}
        kind = model["type"], before["type"], before.get("add_prefix_space"), before.get("use_regex"), spec["normalizer"], (spec["decoder"] or {}).get("type")
        if kind != ("BPE", "ByteLevel", False, True, None, "ByteLevel") or any((model.get(k) or v) != v for k, v in plain.items()):
            raise ValueError(f"{path} is no plain byte-level BPE")
        code = alphabet()
        raw = lambda token: bytes(map(code.__getitem__, token))
        vocab = model["vocab"]
        self.byte_id = [vocab[x] for x in sorted(code, key=code.__getitem__)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: Of a pair of ids, the left one shifted, the rank; of a rank what the pair becomes.
        self.rank_of = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(merges)}
        self.merged_id = [vocab[a + b] for a, b in merges]
        added = spec["added_tokens"]
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in added):
            raise ValueError(f"{path} has added tokens that take what is around them")
        self.special = {x["content"]: array.array("i", [x["id"]]).tobytes() for x in added}
        self.border = regex.compile("|".join(f"({regex.escape(x)})" for x in sorted(self.special, key=len, reverse=True))) if added else None
        self.fast = regex.compile(PATTERN.format(letter=r"\p{L}", number=r"\p{N}", other=r"[^\s\p{L}\p{N}]")).findall
        self.unlike = unlike()
        odd = "".join(sorted(self.unlike))
        self.exact = regex.compile("(?V1)" + PATTERN.format(letter=rf"[\p{{L}}--[{odd}]]", number=rf"[\p{{N}}--[{odd}]]", other=rf"(?:[^\s\p{{L}}\p{{N}}]|[{odd}])")).findall if odd else self.fast
        self.lone = regex.compile(r"(?<=\S) (?=\S)")  # a word begins at such a space, whatever is around it
        pieces = {i: raw(x) for x, i in vocab.items()} | {x["id"]: x["content"].encode() for x in added}
        self.size = max(pieces) + 1  # the id after all others stands for those that are in no vocabulary
        self.pieces = pa.array([pieces.get(i, b"") for i in range(self.size + 1)], pa.binary())

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        ids = array.array("i", self.merged(raw) if len(raw) <= SHORT else self.merged_by_heap(raw)).tobytes()
        if len(word) <= REMEMBERED:
            if len(self) >= CACHED:
                self.clear()
            self[word] = ids
        return ids

    def merged(self, raw: bytes) -> list[int]:
        """The ids of a word's parts: the pair of the least rank is merged, the first of equal ones, until none has a rank."""
        rank_of, none = self.rank_of.get, len(self.merged_id)
        parts = [*map(self.byte_id.__getitem__, raw)]
        ranks = [rank_of(a << 32 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < none:
            at = ranks.index(least)
            part = parts[at] = self.merged_id[least]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of(part << 32 | parts[at + 1], none)
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] << 32 | part, none)
        return parts

    def merged_by_heap(self, raw: bytes) -> list[int]:
        """The same, in time that does not grow with the square: pairs wait in a heap, and parts are chained by where they begin."""
        rank_of, size = self.rank_of.get, len(raw)
        parts, after, before = [*map(self.byte_id.__getitem__, raw)], list(range(1, size + 1)), list(range(-1, size - 1))
        heap: list[tuple[int, int, int, int]] = []  # rank, where the pair begins, and its parts

        def wait(a: int) -> None:
            if (b := after[a]) < size and (rank := rank_of(parts[a] << 32 | parts[b])) is not None:
                heapq.heappush(heap, (rank, a, parts[a], parts[b]))

        for a in range(size - 1):
            wait(a)
        while heap:
            rank, a, left, right = heapq.heappop(heap)
            b = after[a]
            if parts[a] != left or b == size or parts[b] != right:  # a part that is gone is -1
                continue
            parts[a], parts[b], after[a] = self.merged_id[rank], -1, after[b]
            if after[a] < size:
                before[after[a]] = a
            if before[a] >= 0:
                wait(before[a])
            wait(a)
        return [x for x in parts if x >= 0]

    def spans(self, text: str) -> Iterator[str]:
        """The text in spans that are parted into words by themselves, of about ``PART`` characters where it has lone spaces."""
        low = 0
        while len(text) - low > PART and (cut := self.lone.search(text, low + PART)):
            yield text[low:cut.start()]
            low = cut.start()
        yield text[low:]

    def encoded(self, text: str) -> bytes:
        """The text's ids, as 32-bit integers."""
        words = self.fast if text.isascii() or self.unlike.isdisjoint(text) else self.exact
        plain = lambda part: b"".join(b"".join(map(self.__getitem__, words(x))) for x in self.spans(part))
        if self.border is None or not self.border.search(text):
            return plain(text)
        out, low = [], 0
        for found in self.border.finditer(text):
            out += [plain(text[low:found.start()]), self.special[found[0]]]
            low = found.end()
        return b"".join([*out, plain(text[low:])])

    def encode(self, texts: pa.StringArray) -> pa.ListArray:
        ids = [self.encoded(x or "") for x in texts.to_pylist()]
        offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))

    def decode(self, ids: pa.ListArray) -> pa.StringArray:
        """The ids' bytes in a row as text: what is no UTF-8 is replaced, ids of no token are left out."""
        ids = pa.ListArray.from_arrays(*_dense(ids))
        flat = ids.values.to_numpy(zero_copy_only=False)
        taken = self.pieces.take(pa.array(np.where((flat < 0) | (flat >= self.size), self.size, flat)))
        ends = np.frombuffer(taken.buffers()[1], np.int32)[:len(taken) + 1] if len(taken) else np.zeros(1, np.int32)
        offsets = np.ascontiguousarray(ends[ids.offsets.to_numpy()])
        texts = pa.StringArray.from_buffers(len(ids), pa.py_buffer(offsets), taken.buffers()[2] or pa.py_buffer(b""))
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in texts.cast(pa.binary()).to_pylist()], pa.string())
        return texts


def _dense(lists: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """Offsets from 0 and values of a list column; a null list is an empty one, a null id none of the vocabulary's."""
    sizes = np.array([x or 0 for x in lists.value_lengths().to_pylist()], np.int64)
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), lists.flatten().fill_null(-1)


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Bpe:
    """One for each worker process, so that what it remembers serves all its tasks."""
    return Bpe(path)


def encode(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of each row of ``docs``, in the vocabulary of a tokenizers file that every worker can read.

    A null text counts as empty and has no ids. Ids that are null or repeat stay with their rows. An empty table gives an empty result; a very long text is
    held whole, once, with its ids. Other columns are ignored, whatever their names. Special tokens' strings in a text are those tokens; none is added.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary_of(vocabulary)
        for batch in batches:
            for part in portions(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), bpe.encode(part.column(1))], names=["doc_id", "ids"])

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids, text of rows with doc_id and ids. Special tokens are kept. A null list is an empty text; ids that are null or in no vocabulary are left out, bytes that are no UTF-8 replaced."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary_of(vocabulary)
        for batch in batches:
            for part in portions(batch):  # a list's offsets are as a text's: so many ids at most
                yield pa.RecordBatch.from_arrays([*part.columns, bpe.decode(part.column(1))], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
