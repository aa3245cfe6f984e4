"""Packing into sequences (op2) by order-preserving dynamic programming.

The documents of a partition, in its order, are one stream of token ids. A window is a
run of that stream of at most ``length`` ids; its cost is its padding plus the penalty of where it
ends: none at a document's end, a little at a sentence's end, more elsewhere. With f(j) the least
cost of cutting the stream at j,

    f(j) = penalty(j) + length - j + min { f(i) + i : j - length <= i < j }

so a monotone queue over f(i) + i gives each f(j) in constant time. Cuts are made at ends of documents
and of sentences; only within a run of more than ``length`` ids without any, where none is in reach, at every ``grid``-th id of the run, at a price of its own. A partition is packed in blocks: the last,
unfinished window of a block is carried into the next, so memory is bounded by a block and one
document. The last window of a partition is what is left, padded as any other. No row moves between tasks.
"""

from __future__ import annotations

import array
import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import fresh, portions

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END = 1
SPECIAL = "<|endoftext|>"
#: Where splitting at a space could part what the tokenizer takes together.
UNEVEN = r"[\s\p{Z}\x0b\x1c-\x1f\x85]{2}|^[\s\p{Z}\x0b\x1c-\x1f\x85]|[\s\p{Z}\x0b\x1c-\x1f\x85]$"
STOPS = tuple(x.encode() for x in ".!?…。！？।")
CACHED = 100_000
#: Texts that are tokenised together, and their bytes, but for a longer one.
TEXTS, BYTES = 1024, 1 << 20


class Tokens(dict):
    """Token ids, as little-endian 32-bit bytes, of a space and what follows it up to the next one.

    Byte-level BPE splits before a lone space in any case, so a text without runs of white space is
    the concatenation of these. ``ranks`` is the same vocabulary as the JSON file's, and its encoder is faster.
    """

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(vocabulary.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.vocabulary, self.json = vocabulary, None
        self.ends = np.zeros(max(ranks.values()) + 2, bool)
        self.sizes = np.zeros(len(self.ends), np.int64)
        for piece, rank in ranks.items():
            self.sizes[rank] = len(piece)
            self.ends[rank] = piece.rstrip().endswith(STOPS) or b"\n" in piece

    def learn(self, words: list[str]) -> None:
        """Encodes words it does not have all at once, and parts the ids where the words' bytes end."""
        if len(self) >= CACHED:
            self.clear()
        new = [w for w in words if w not in self]
        if not new:
            return
        ids = np.array(self.encode(" " + " ".join(new)), "<u4")
        stops = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(w.encode()) + 1 for w in new])) + 1
        raw, low = ids.tobytes(), 0
        for word, high in zip(new, (stops * 4).tolist(), strict=True):
            self[word] = raw[low:high]
            low = high

    def alone(self, text: str) -> bytes:
        if SPECIAL not in text:
            return array.array("I", self.encode(text)).tobytes()
        if self.json is None:  # the JSON file's own rule for its special token
            from tokenizers import Tokenizer

            self.json = Tokenizer.from_file(self.vocabulary)
        return array.array("I", self.json.encode(text, add_special_tokens=False).ids).tobytes()

    def stream(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with id 1 at its end, in one array; and each text's number of ids."""
        odd = pc.or_(pc.match_substring_regex(texts, UNEVEN), pc.match_substring(texts, SPECIAL))
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        starts = lists.offsets.to_numpy()
        starts = starts - starts[0]
        words = lists.flatten()
        coded = words.dictionary_encode()
        uniques = coded.dictionary.to_pylist()
        self.learn(uniques)
        firsts = pc.if_else(odd, texts, words.take(pa.array(starts[:-1]))).to_pylist()
        pieces = [*map(self.__getitem__, uniques), *map(self.alone, firsts), array.array("I", [END]).tobytes()]
        codes = np.empty(len(words) + len(texts), np.int64)
        last = starts[1:] + np.arange(len(texts))
        inner = np.ones(len(codes), bool)
        inner[last] = False
        codes[inner] = coded.indices.to_numpy()
        codes[starts[:-1] + np.arange(len(texts))] = len(uniques) + np.arange(len(texts))
        codes[last] = len(pieces) - 1
        sizes = np.array([len(x) // 4 for x in pieces])
        begins = np.cumsum(sizes) - sizes
        each = sizes[codes]
        ends = np.cumsum(each)
        flat = np.frombuffer(b"".join(pieces), "<u4")
        return flat[np.repeat(begins[codes] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)], np.diff(ends[last], prepend=0)


def cut(ends: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """Indices into ``ends`` of the best window ends.

    ``ends``: increasing positions where a cut may be, at most ``length`` apart; the last is one. The queue holds
    g(i) = f(i) + i, increasing; g(j) = penalty(j) + length + min g(i).
    """
    where, value, index, head = [0], [0.0], [-1], 0  # the queue is what lies from ``head`` on
    back = []
    keep = back.append
    for j, (here, price) in enumerate(zip(ends.tolist(), (penalties + length).tolist(), strict=True)):
        low = here - length
        while where[head] < low:
            head += 1
        keep(index[head])
        g = value[head] + price
        while value[-1] >= g and len(value) > head:
            value.pop()
            where.pop()
            index.pop()
        value.append(g)
        where.append(here)
        index.append(j)
    chosen, j = [], len(ends) - 1
    while j >= 0:
        chosen.append(j)
        j = back[j]
    return chosen[::-1]


class Packer:
    """Packs one partition's stream. Of the first document held, ``skip`` ids are in windows that are done."""

    def __init__(self, partition: int, length: int, grid: int, sentence: float, inside: float, flags: np.ndarray) -> None:
        self.length, self.grid, self.sentence, self.inside, self.flags = length, grid, sentence, inside, flags
        self.next, self.skip = partition << 33, 0
        self.ids: list = []
        self.sizes = np.zeros(0, np.int64)
        self.held = np.zeros(0, "<u4")
        self.out: dict[str, list] = {}
        self.batch()

    def add(self, ids: list, stream: np.ndarray, sizes: np.ndarray) -> None:
        self.ids += ids
        self.sizes = np.concatenate([self.sizes, sizes])
        self.held = np.concatenate([self.held, stream])

    def pack(self, last: bool) -> None:
        """Packs what is held but for the last window; if ``last``, all of it."""
        stream = self.held
        if not len(stream):
            return
        final = np.cumsum(self.sizes) - self.skip
        price = np.where(self.flags[stream], self.sentence, np.inf)
        price[final - 1] = 0
        ends = np.flatnonzero(price < np.inf)
        starts = np.concatenate([[-1], ends[:-1]])
        for run in np.flatnonzero(ends - starts > self.length):
            price[starts[run] + self.grid:ends[run]:self.grid] = self.inside
        where = np.flatnonzero(price < np.inf)
        edges = [0, *(where[cut(where + 1, price[where], self.length)] + 1).tolist()]
        if not last:
            edges.pop()
        self._emit(stream, final, edges)
        used = edges[-1]
        done = int(np.searchsorted(final, used, side="right"))
        self.skip = used - int(final[done - 1]) if done else used + self.skip
        self.ids, self.sizes, self.held = self.ids[done:], self.sizes[done:], stream[used:]

    def _emit(self, stream: np.ndarray, final: np.ndarray, edges: list[int]) -> None:
        raw, out = stream.tobytes(), self.out
        doc, begin, stops, sizes = 0, -self.skip, final.tolist(), self.sizes.tolist()  # begin: where the document does in the stream
        for low, high in zip(edges, edges[1:], strict=False):
            place = low
            while place < high:
                until = min(high, stops[doc])
                piece = (self.ids[doc], place - begin, until - place, zlib.crc32(raw[4 * place:4 * until]), sizes[doc], self.next, place - low)
                for name, x in zip(out, piece, strict=True):
                    out[name].append(x)
                if until == stops[doc]:
                    begin = until
                    doc += 1
                place = until
            self.next += 1

    def batch(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in self.out.items()}) if self.out else None
        self.out = {name.split()[0]: [] for name in SCHEMA.split(", ")}
        return batch


def pack(docs: DataFrame, vocabulary: str, *, length: int = 2048, grid: int = 32, sentence: float = 2.0, inside: float = 24.0,
         block: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its text (a null text counts as empty) and then id 1. ``sentence`` and ``inside``
    are penalties, in ids of padding, for a cut at a sentence's end and, in a run of more than ``length`` ids without one, at every ``grid``-th. A null id is kept as null;
    rows that repeat an id are documents of their own, each with all its pieces. An empty table gives an empty
    result; a very long text is held whole, once. Other columns are ignored, whatever their names. ``length`` is a power of two.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        tokens = Tokens(vocabulary)
        packer = Packer(TaskContext.get().partitionId(), length, grid, sentence, inside, tokens.ends)
        for batch in batches:
            for part in portions(batch, rows=TEXTS, size=BYTES):
                packer.add(part.column(0).to_pylist(), *tokens.stream(part.column(1)))
                if len(packer.held) >= block:
                    packer.pack(last=False)
                    yield packer.batch()
        packer.pack(last=True)
        yield packer.batch()

    return docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(run, SCHEMA)
