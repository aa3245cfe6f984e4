"""The corpus pipeline against a brute-force version: each stage on what the one before it kept."""

import zlib
from collections import Counter
from fractions import Fraction

import brute
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pagewright.llm import quality, queries


def survivors(docs, kept):
    """Rows (doc_id, text, ...) in the order of ``docs`` for which ``kept`` holds."""
    return [d for d, k in zip(docs, kept, strict=True) if k]


def plain_stages(spark, sf_dir, docs):
    """What is left after each stage but the last, and how often."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    left = survivors(docs, [brute.quality(d[1] or "", *model) >= 0.3 for d in docs])
    yield Counter(left)
    left = survivors(left, [g[3] for g in brute.exact_groups([d[:2] for d in left])])
    yield Counter(left)
    left = survivors(left, [i == c for i, _, c in brute.jaccard([d[:2] for d in left], 5, Fraction(4, 5))])
    yield Counter(left)
    yield Counter(dict(zip(left, brute.repeats([(d[0], d[1], d[3]) for d in left], queries.WEIGHTS), strict=True)))


def test_stages_and_run(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain_stages(spark, sf_dir, [tuple(r) for r in docs.collect()])
    columns, given, dropped = docs.columns, docs.count(), []
    for at, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(at)))
        docs = spark.read.parquet(str(tmp_path / str(at)))
        assert docs.columns == columns
        got = Counter(tuple(r) for r in docs.collect())
        assert got == +next(want)
        dropped.append(given - len(got))
        given = len(got)
    assert all(dropped)
    tokenizer = Tokenizer.from_file(queries.vocabulary())
    whole = Counter()
    for (i, text, *_), n in got.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        whole[i, len(ids), zlib.crc32(ids.tobytes()) if len(ids) < 200 else 0] += n
    for out in (corpus_pipeline.STAGES[4][1](spark, docs, sf_dir), corpus_pipeline.run(spark, sf_dir)):
        rows = out.toPandas()
        for _, window in rows.sort_values("offset").groupby("sequence_id"):
            assert window["offset"].tolist() == [0, *window["length"].cumsum()[:-1]] and window["length"].sum() <= 2048
        firsts = Counter(rows[rows["start"] == 0][["doc_id", "doc_tokens"]].itertuples(index=False, name=None))
        assert firsts == sum((Counter({k[:2]: n}) for k, n in whole.items()), Counter())
        assert rows["length"].sum() == sum(k[1] * n for k, n in whole.items())
        one = rows[(rows["length"] == rows["doc_tokens"]) & (rows["doc_tokens"] < 200)]
        assert set(one[["doc_id", "doc_tokens", "ids_crc32"]].itertuples(index=False, name=None)) <= set(whole)


@pytest.mark.parametrize("at", range(4))
def test_stages_on_odd_tables(spark, sf_dir, docs, documents, nothing, at):
    """Nulls, empty and long texts, rows that repeat, columns with the names that operators use; an empty table."""
    stage = corpus_pipeline.STAGES[at][1]
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    given = Counter(map(str, docs.collect()))
    got = Counter(map(str, out.collect()))
    assert got and set(got) <= set(given)
    if at < 3:
        assert not got - given
    if at == 1:
        assert len(got) == len({(i, brute.folded(t)) for (i, t), g in zip(documents, brute.exact_groups(documents), strict=True) if g[3]})
    empty = stage(spark, nothing, sf_dir)
    assert empty.columns == docs.columns and empty.isEmpty()


def test_packing_of_an_empty_table(spark, sf_dir, nothing):
    assert corpus_pipeline.packed(spark, nothing, sf_dir).isEmpty()
