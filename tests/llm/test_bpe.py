"""BPE against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pagewright.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(PATH)


def odd_texts(n, seed):
    rng = random.Random(seed)
    letter = lambda: chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x40000)]))
    parts = ["a", "é", "the", " ", "  ", "\n", "\t", "'s", "'", "1", "23", "中文", "😀", "\x00", "\x85", "　", "<|endoftext|>", "<|", "!!", "...", "́", "Ᲊ", "Ꟛ"]
    return ["".join(rng.choice([*parts, letter(), "abc" * rng.randrange(1, 200)]) for _ in range(rng.randrange(rng.choice([2, 6, 50, 400])))) for _ in range(n)]


def test_odd_texts(own, library):
    texts = odd_texts(1500, 1)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    got = own.encode(pa.array(texts))
    assert got.to_pylist() == want
    assert own.decode(got).to_pylist() == texts == library.decode_batch(want, skip_special_tokens=False)


def test_characters_of_later_unicode(own, library):
    texts = [f"a{x}b {x}'s 1{x}2 !{x}? " for x in sorted(own.unlike)]
    assert own.encode(pa.array(texts)).to_pylist() == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_ids_of_no_text(own, library):
    rng = random.Random(2)
    lists = [[rng.randrange(50_257) for _ in range(rng.randrange(30))] for _ in range(2000)]
    assert own.decode(pa.array(lists, pa.list_(pa.int32()))).to_pylist() == library.decode_batch(lists, skip_special_tokens=False)
    assert own.decode(pa.array([[0, None, -1, 99_999, 1], None, []], pa.list_(pa.int32()))).to_pylist() == ['!"', "", ""]
    assert own.decode(pa.array([[5], [0], [1, 2]], pa.list_(pa.int32()))[1:]).to_pylist() == ["!", '"#']


def test_scans_and_heap_agree(own):
    rng = random.Random(3)
    for n in [*range(1, 40), 100, 256, 300, 700]:
        for _ in range(10):
            word = bytes(rng.choice(b"aabcdeth in\xe9\x00") for _ in range(n))
            assert own.merged(word) == own.merged_by_heap(word)
    assert own.merged(b"a" * 500) == own.merged_by_heap(b"a" * 500)


@pytest.mark.parametrize("text", ["x" * 200_000, "word and " * 300_000, "a.b" * 400_000, " " * 100_000 + "x", "Zeile\n\n" * 50_000])
def test_long_texts(own, library, text):
    assert own.encode(pa.array([text])).to_pylist()[0] == library.encode(text, add_special_tokens=False).ids


def test_what_is_remembered_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    texts = odd_texts(200, 4)
    assert bpe.Bpe(PATH).encode(pa.array(texts)).to_pylist() == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"))


def test_tables(spark, docs, documents, nothing, library):
    encoded = bpe.encode(docs, PATH)
    rows = bpe.decode(encoded, PATH).collect()
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in documents]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    assert bpe.decode(bpe.encode(nothing, PATH), PATH).isEmpty()
    lists = spark.createDataFrame([(1, None), (2, [0, None])], "doc_id long, ids array<int>")
    assert sorted((r["doc_id"], r["text"]) for r in bpe.decode(lists, PATH).collect()) == [(1, ""), (2, "!")]


def test_query(spark, sf_dir, library):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, queries.QUERIES["op11_bpe_round_trip"](spark, sf_dir).collect())) == sorted(want)
