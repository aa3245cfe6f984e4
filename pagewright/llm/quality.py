"""Quality classifier (op4): supervised subword embeddings, trained by stochastic gradient descent in numpy.

A document is the mean of learned vectors: one for each word (white space parts them; case stays), one for each
of a word's character n-grams with its borders marked, and one for each two words in a row. Two words are hashed by the exclusive or of
their hashes, so their order is not told apart, and all words that follow themselves have one vector. All are hashed into one table of ``BUCKETS`` vectors. A
linear layer and a softmax turn the mean into the probability of label 1.

The softmax of two classes needs only the difference of their logits, and that is the mean, over a document's
features, of one number for each bucket: the model is collapsed to that table (1 MB, sent with the tasks).
A text of any length is scored whole,
in one pass, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 17
#: Labelled rows that the model is trained on, at most.
SAMPLE = 1500
#: Characters that are hashed together, about; a longer text is cut at white space, where only pairs of words go across; these are added, so its score is that of the whole.
PART = 1 << 19
BORDER = np.uint32(1)
FACTORS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


def bucket(mixed: np.ndarray) -> np.ndarray:
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519)
    return mixed >> np.uint32(15)  # 17 bits


SPACE = re.compile("[\x00- ]")


def parts(text: str) -> list[str]:
    """The text, cut behind the first border after each ``PART`` characters."""
    out, low = [], 0
    while len(text) - low > PART and (border := SPACE.search(text, low + PART)):
        out.append(text[low:border.end()])
        low = border.end()
    return [*out, text[low:]]


def hashed(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """What the texts' features are, text after text, each text led by a border.

    Character n-grams for n = 2, 3, 4: a bucket for each place, and whether an n-gram starts there. Where each
    text starts. Words: where each starts, and its hash.
    """
    codes = np.frombuffer("".join(chain.from_iterable(("\x01", x) for x in [*texts, ""])).encode("utf-32-le"), "<u4").astype(np.uint32)
    codes = np.where(codes <= 32, BORDER, codes)
    begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
    inner = codes != BORDER
    padded = np.concatenate([codes, np.full(3, BORDER)])
    here = np.concatenate([inner, np.zeros(3, bool)])
    size, grams = len(codes), []
    mixed = codes * FACTORS[0] + padded[1:size + 1] * FACTORS[1]
    valid = inner | here[1:size + 1]
    grams.append((bucket(mixed), valid))
    valid = here[1:size + 1]
    for n in (3, 4):
        mixed = mixed + padded[n - 1:size + n - 1] * FACTORS[n - 1] + np.uint32(n)
        grams.append((bucket(mixed), valid))
        valid = valid & here[n - 1:size + n - 1]
    starts = np.flatnonzero(inner & ~np.concatenate([[False], inner[:-1]]))
    if not len(starts):
        return grams, begins, (starts, np.zeros(0, np.uint32))
    first = np.zeros(size, np.int64)
    first[starts] = starts
    place = np.arange(size) - np.maximum.accumulate(first)
    terms = np.where(inner, (codes * FACTORS[2] + place.astype(np.uint32)) * FACTORS[0], 0).astype(np.uint32)
    terms = (terms ^ (terms >> np.uint32(13))) * FACTORS[1]
    terms[~inner] = 0
    return grams, begins, (starts, np.add.reduceat(terms, starts).astype(np.uint32))


def two(words: np.ndarray, following: np.ndarray) -> np.ndarray:
    return bucket((words ^ following) + FACTORS[3])


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets, each once, and how often each occurs."""
    counts, every = np.zeros(BUCKETS), []
    for part in parts(text):
        grams, _, (_, words) = hashed([part])
        for ids, valid in grams:
            counts += np.bincount(ids[valid], minlength=BUCKETS)
        every.append(words)
    words = np.concatenate(every)
    counts += np.bincount(np.concatenate([bucket(words), two(words[:-1], words[1:])]), minlength=BUCKETS)
    ids = np.flatnonzero(counts)
    return ids, counts[ids]


def train(texts: list[str], labels: np.ndarray, *, dim: int = 8, epochs: int = 12, rate: float = 0.5, seed: int = 0) -> tuple[np.ndarray, float]:
    """One number for each bucket, and a bias: a document's logit is the bias plus the mean of its features' numbers."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / dim, 1 / dim, (BUCKETS, dim))
    layer, bias = np.zeros((2, dim)), np.zeros(2)
    sparse = [features(x) for x in texts]
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    steps, done = max(1, epochs * len(texts)), 0
    for _ in range(epochs):
        for i in random.permutation(len(texts)):
            ids, counts = sparse[i]
            step = rate * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            weight = counts / counts.sum()
            mean = weight @ vectors[ids]
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            pull = layer.T @ p
            layer -= step * np.outer(p, mean)
            bias -= 0.05 * step * p
            vectors[ids] -= (step * len(ids) ** 0.5 * weight)[:, None] * pull
    if share.min() == 0:  # one class only, or no labels at all
        return np.zeros(BUCKETS), 0.0 if not len(labels) else (4.0 if share[1] else -4.0)
    return vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5) -> tuple[np.ndarray, float]:
    """A model from at most ``sample`` labelled rows of the learning folds (crc32 of the id modulo ``folds`` is not 0), the least by a hash of the id.

    The sample is drawn before any text is read, and trained on in one task: its size is the parameter's and does not grow with the data. An id with
    both labels counts as 1, and of the texts under one id the least is learned; ids that are null or without a text, and labels other than 0 and 1, are left out. Other columns are
    ignored, whatever their names. An empty table gives a model that scores 0.5.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).where("_label in (0, 1) and _id is not null")
    known = known.where(F.crc32(F.col("_id").cast("string")) % folds != 0).groupBy("_id").agg(F.max("_label").cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_label").alias("_label"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = pd.concat([*batches] or [pd.DataFrame({"_id": [], "_text": [], "_label": []})]).sort_values("_id")
        table, bias = train(found["_text"].tolist(), found["_label"].to_numpy(np.int64))
        yield pd.DataFrame({"table": [table.astype("<f8").tobytes()], "bias": [bias]})

    row = rows.repartition(1).mapInPandas(run, "table binary, bias double").first()
    return (np.frombuffer(row["table"], "<f8"), row["bias"]) if row else (np.zeros(BUCKETS), 0.0)


def logits(texts: list[str], table: np.ndarray) -> np.ndarray:
    """The mean of each text's features' numbers; 0 without features."""
    pieces = [(i, part) for i, text in enumerate(texts) for part in parts(text)]
    sums, sizes, low = np.zeros(len(texts)), np.zeros(len(texts)), 0
    last, last_of = np.zeros(0, np.uint32), np.zeros(0, np.int64)  # the word before the next piece, and its text
    while low < len(pieces):
        high, held = low, 0
        while high < len(pieces) and (high == low or held + len(pieces[high][1]) <= PART):
            held += len(pieces[high][1])
            high += 1
        of = np.array([i for i, _ in pieces[low:high]])
        grams, begins, (starts, words) = hashed([x for _, x in pieces[low:high]])
        value, count = np.zeros(len(grams[0][0])), np.zeros(len(grams[0][0]), np.int64)
        for ids, valid in grams:
            value += np.where(valid, table[ids], 0)
            count += valid
        of_word = of[np.searchsorted(begins, starts, side="right") - 1]
        np.add.at(sums, of, np.add.reduceat(value, begins[:-1]))
        np.add.at(sizes, of, np.add.reduceat(count, begins[:-1]))
        before, before_of = np.concatenate([last, words]), np.concatenate([last_of, of_word])
        pair = np.flatnonzero(before_of[:-1] == before_of[1:])
        which = np.concatenate([of_word, before_of[pair]])
        sums += np.bincount(which, table[np.concatenate([bucket(words), two(before[pair], before[pair + 1])])], minlength=len(texts))
        sizes += np.bincount(which, minlength=len(texts))
        last, last_of = before[-1:], before_of[-1:]
        low = high
    return np.divide(sums, sizes, out=np.zeros(len(texts)), where=sizes > 0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A null or empty text, or one without words, gets the score of the bias alone. Rows that repeat an id are scored each. A null id is
    not held out. With no label to learn from every score is 0.5. Other columns are ignored.
    """
    table, bias = model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z = logits(batch["_text"].tolist(), table) + bias
            yield pd.DataFrame({"doc_id": batch["_id"], "score": 1 / (1 + np.exp(-z))})

    scored = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInPandas(run, "doc_id long, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: tuple[np.ndarray, float], *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their own columns, whatever their names, whose score is ``threshold`` or more.

    A null or empty text has the score of the bias alone; rows that repeat others stay or go with them; an empty table gives an empty result. The rows pass through the scoring task and are not shuffled or joined.
    """
    table, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            score = 1 / (1 + np.exp(-(logits([x or "" for x in texts], table) + bias)))
            yield batch.filter(pa.array(score >= threshold))

    at, plain = docs.columns.index(text_col), docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names may hold dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
