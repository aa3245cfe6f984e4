import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from fractions import Fraction
from pyspark.sql import functions as F

from pagewright.llm import embedding_dedup, exact_dedup, jaccard, substring_dedup
from pagewright.llm.components import components
from pagewright.llm.linking import hook
from pagewright.llm.scratch import Scratch


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def same(frame, expected):
    assert rows(frame) == sorted(expected, key=repr)


def test_exact(docs, documents, nothing):
    same(exact_dedup.exact_groups(docs, files_per_trigger=1), brute.exact_groups(documents))
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_exact_survives_digests_that_collide(docs, documents):
    got = exact_dedup.exact_groups(docs, digest=lambda text: F.sha2(F.substring(text, 1, 1), 256))
    same(got, brute.exact_groups(documents))


@pytest.mark.parametrize("told", [True, False])
def test_a_second_batch_meets_the_state_of_the_first(spark, documents, tmp_path, told):
    parts = [documents[::2], documents[1::2]]
    weak = lambda text: F.sha2(F.substring(text, 1, 1), 256)
    for digest in (exact_dedup.sha256_hex, weak):
        folder, got = str(tmp_path / digest.__name__[:3]), []
        for i, part in enumerate(parts):
            spark.createDataFrame(part, "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/rows-{i}")
            earlier = spark.read.parquet(f"{folder}/rows-0") if told and i else None
            got.append(exact_dedup.exact_groups(spark.read.parquet(f"{folder}/rows-{i}"), state_dir=f"file://{folder}/state", earlier=earlier, digest=digest))
        same(got[0], brute.exact_groups(parts[0]))
        if digest is weak:  # what collides is told apart, so no text goes for another's sake
            texts = {brute.sha(brute.folded(t)) for i, t in parts[1]}
            assert {r["text_sha256"] for r in got[1].collect()} == texts
        else:
            whole = {(i, brute.folded(t)): row for (i, t), row in zip(documents, brute.exact_groups(documents), strict=True)}
            same(got[1], [whole[i, brute.folded(t)] for i, t in parts[1]])
    assert exact_dedup.exact_groups(spark.createDataFrame([], "doc_id long, text string"), state_dir=f"file://{folder}/state").isEmpty()


@pytest.mark.parametrize("fails_at", [None, "_arrive", "_entries"])
def test_a_batch_with_a_name_counts_once(spark, documents, tmp_path, monkeypatch, fails_at):
    weak = lambda text: F.sha2(F.substring(text, 1, 1), 256)
    parts = [documents[::2], documents[1::2]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, "doc_id long, text string").write.parquet(f"{tmp_path}/rows-{i}")
    call = lambda i, d=exact_dedup.sha256_hex: sorted(map(repr, map(tuple, exact_dedup.exact_groups(spark.read.parquet(f"{tmp_path}/rows-{i}"), state_dir=f"file://{tmp_path}/{d.__name__[:3]}", batch=f"part {i}", digest=d).collect())))
    first = call(0)
    if fails_at:
        with monkeypatch.context() as patch:
            own, calls = getattr(exact_dedup, fails_at), []

            def failing(*given):
                calls.append(1)
                if len(calls) == (2 if fails_at == "_entries" else 1):  # before the stream starts; after it ended
                    raise RuntimeError("lost")
                return own(*given)

            patch.setattr(exact_dedup, fails_at, failing)
            with pytest.raises(RuntimeError):
                call(1)
    second = call(1)
    whole = {(i, brute.folded(t)): row for (i, t), row in zip(documents, brute.exact_groups(documents), strict=True)}
    assert first == sorted(map(repr, brute.exact_groups(parts[0]))) and second == sorted(repr(whole[i, brute.folded(t)]) for i, t in parts[1])
    assert call(0) == first and call(1) == second
    if not fails_at:
        both = [call(i, weak) for i in (0, 1)]
        assert [call(i, weak) for i in (0, 1)] == both


def test_exact_rows(docs, documents):
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    want = {(i, brute.folded(t)) for (i, t), g in zip(documents, brute.exact_groups(documents), strict=True) if g[3]}
    assert sorted(((r["doc_id"], brute.folded(r["text"])) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert {(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()} <= set(documents)


def test_substring(docs, documents, nothing):
    same(substring_dedup.substring_dedup(docs), brute.substring(documents))
    assert substring_dedup.substring_dedup(nothing).count() == 0


@pytest.mark.parametrize("window", [7, 20, 45, 100])
def test_substring_of_other_lengths(docs, documents, window):
    same(substring_dedup.substring_dedup(docs, window=window), brute.substring(documents, window))


def test_substring_over_many_partitions(docs, documents):
    same(substring_dedup.substring_dedup(docs.repartition(11)), brute.substring(documents))


@pytest.mark.parametrize("k,similarity", [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
@pytest.mark.parametrize("chunk", [512, 4])
def test_jaccard(docs, documents, k, similarity, chunk):
    same(jaccard.jaccard_components(docs, k=k, similarity=similarity, chunk=chunk), brute.jaccard(documents, k, similarity))


def test_jaccard_of_nothing(nothing):
    assert jaccard.jaccard_components(nothing).count() == 0


def half_similar(seed):
    """24 groups of 32 texts: 30 that share more than half of one text, that text, and one that is just similar to it."""
    rng, groups = random.Random(seed), []
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    for _ in range(24):
        base = [word() for _ in range(16)]
        groups.append([" ".join([word() for _ in range(rng.randrange(2, 6))] + base[6:]) for _ in range(30)] + [" ".join(base), " ".join(base + [word() for _ in range(3)])])
    return groups


@pytest.mark.parametrize("partitions", [1, 5])
def test_half_similar_texts_do_not_part_similar_ones(spark, partitions):
    given, want = [], []
    for group in half_similar(5):
        rows_ = list(enumerate(group, len(given)))
        given += rows_
        want += brute.jaccard(rows_, 5, Fraction(4, 5))  # groups have no words in common
    assert sum(i != c for i, _, c in want) >= 24
    same(jaccard.jaccard_components(spark.createDataFrame(given, "doc_id long, text string").repartition(partitions), k=5, similarity=Fraction(4, 5)), want)


def families(seed):
    """Template letters: 16 common words and 5 of their own; of each, another with one word at an end changed, left out or added."""
    rng, out = random.Random(seed), []
    for _ in range(40):
        common = [f"c{rng.randrange(10 ** 6)}" for _ in range(16)]
        for _ in range(18):
            own = [f"o{rng.randrange(10 ** 6)}" for _ in range(5)]
            letter = [w for at in range(5) for w in (*common[at * 3:at * 3 + 3], own[at])] + common[15:]
            out += [" ".join(letter), " ".join(rng.choice([letter[:-1] + [f"x{rng.randrange(10 ** 6)}"], letter[1:], [f"y{rng.randrange(10 ** 6)}", *letter], letter + ["z"]]))]
    return list(enumerate(out))


@pytest.mark.parametrize("k,similarity", [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (1, Fraction(4, 5))])
def test_template_letters_lose_no_link(spark, k, similarity):
    given = families(7)
    want = brute.jaccard(given, k, similarity)
    assert sum(i != c for i, _, c in want) > 100
    frame = spark.createDataFrame(given, "doc_id long, text string")
    for chunk in (512, 8):
        same(jaccard.jaccard_components(frame.repartition(3), k=k, similarity=similarity, chunk=chunk), want)


def test_chains_connect_all_that_agree():
    rng = np.random.default_rng(6)
    windows = jaccard.Windows(Fraction(9, 10))
    for _ in range(50):
        bitmaps = rng.integers(-1 << 63, 1 << 63, 1) ^ np.packbits(rng.random((60, 64)) < rng.choice([0.05, 0.12], 60)[:, None], axis=1).view(np.int64)[:, 0]
        keys, nodes, sizes = np.sort(rng.integers(0, 4, 60)), rng.permutation(60), rng.integers(90, 110, 60)
        agree = jaccard.Agree(bitmaps, sizes | 1 << jaccard.SIZE, windows)
        links = jaccard.chains(keys, nodes, agree)
        pairs = [(a, b) for a in range(60) for b in range(a) if keys[a] == keys[b] and (int(bitmaps[a] ^ bitmaps[b]) & (1 << 64) - 1).bit_count() <= (sizes[a] + sizes[b]) // 19 and min(sizes[a], sizes[b]) * 10 >= max(sizes[a], sizes[b]) * 9]
        assert brute.components(60, links.tolist()) == brute.components(60, [(nodes[a], nodes[b]) for a, b in pairs])


@pytest.mark.parametrize("similarity", [Fraction(9, 10), Fraction(4, 5), Fraction(1, 2)])
def test_similar_sets_have_a_signature_in_common_and_agree(similarity):
    """At the very threshold, for sets of 1 to 6,000 shingles, few or all of which lie in one place of the hash."""
    rng, windows = np.random.default_rng(0), jaccard.Windows(similarity)
    for n in [*range(1, 60), *rng.integers(60, 6000, 60).tolist()]:
        x = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64) if n % 3 else (rng.integers(1, 1 << 18, n).astype(np.uint64) << np.uint64(20)))
        for more in {0, int(rng.integers(0, 5)), len(x)}:
            y = np.unique(np.concatenate([rng.permutation(x)[int(rng.integers(0, 1 + windows.differ(2 * len(x)) // 2)):], rng.integers(1, 1 << 62, more).astype(np.uint64)]))
            for y in (y, x, rng.permutation(x)[:len(x) - int(len(x) * (1 - similarity))]):
                y = np.sort(y)
                shared = len(np.intersect1d(x, y))
                if not len(y) or shared < similarity * (len(x) + len(y) - shared):
                    continue
                owner, keys, bitmaps, sizes = jaccard.signatures([x, y], windows)
                agree, mine = jaccard.Agree(bitmaps, sizes, windows), {key: i for i, key in enumerate(keys.tolist()) if owner[i] == 0}
                pairs = np.array([(mine[key], i) for i, key in enumerate(keys.tolist()) if owner[i] == 1 and key in mine]).reshape(-1, 2)
                assert agree(pairs[:, 0], pairs[:, 1]).any(), (len(x), len(y), shared)


def test_equal_rows_have_one_that_stands_for_them():
    rng = np.random.default_rng(3)
    for n in (0, 1, 200):
        keys, bitmaps, sizes = (rng.integers(-2, 2, n) for _ in range(3))
        found = jaccard.stands_for(keys, bitmaps, sizes)
        rows_ = list(zip(keys, bitmaps, sizes, strict=True))
        assert all(rows_[f] == r for f, r in zip(found, rows_, strict=True)) and len(set(found.tolist())) == len(set(rows_))


def test_classes_with_one_name_are_told_apart(docs, documents, monkeypatch):
    monkeypatch.setattr(jaccard, "digest_of", one_name)
    same(jaccard.jaccard_components(docs), brute.jaccard(documents))


def one_name(items):
    import hashlib

    whole = hashlib.md5(items.tobytes()).digest()
    return bytes([whole[0] % 8]) * 8 + whole[8:]


def test_near_dedup_keeps_one_of_each_group(docs, documents):
    kept = jaccard.near_dedup(docs, k=5, similarity=Fraction(4, 5))
    assert kept.columns == docs.columns
    gone = {i for i, _, c in brute.jaccard(documents, 5, Fraction(4, 5)) if i is not None and i != c}
    assert sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=repr) == sorted((i for i, _ in documents if i not in gone), key=repr)


def test_words():
    hashes, sizes = jaccard.word_hashes(pa.array(["", " a  b ", "\x0ba\x0c", "a\x1cb", "A b"]), fold=True)
    assert sizes.tolist() == [0, 2, 1, 1, 2]
    assert hashes[0] == hashes[2] == hashes[4]


def vectors():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((6, 16))
    out = []
    for i in range(90):
        v = base[i % 6] + rng.standard_normal(16) * [0.0, 0.02, 0.12, 0.25][i % 4]
        out.append((i, v.astype(np.float32).astype(float).tolist(), None if i % 31 == 5 else i % 2))
    bad = [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] + [1.0] * 15, 1), (203, [float("inf")] + [1.0] * 15, 1), (204, [None] + [1.0] * 15, 1), (205, [], 1), (206, [1.0, 2.0], 1), (207, [2.0, 4.0], 1)]
    return out + bad + [out[8], out[8], (3, out[14][1], out[14][2])]


def test_embeddings(spark):
    given = vectors()
    frame = spark.createDataFrame(given, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)).withColumn("table", F.lit("x"))
    want = brute.embeddings([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in given])
    for block in (512, 4):
        same(embedding_dedup.embedding_links(frame, block=block), want)
    assert embedding_dedup.embedding_links(frame.limit(0)).count() == 0


def test_embedding_recall_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    a = rng.standard_normal((300, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.standard_normal((300, 64))
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = 0.9802 * a + np.sqrt(1 - 0.9802 ** 2) * side
    rows_ = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([a, b]))]
    got = embedding_dedup.embedding_links(spark.createDataFrame(rows_, "vec_id long, embedding array<double>, label int"))
    assert got.agg(F.sum("n_links")).first()[0] >= 0.95 * 600


def test_many_links_at_once():
    rng = np.random.default_rng(8)
    for n, m in ((50, 0), (50, 30), (300, 200), (300, 5000)):
        x, y = rng.integers(0, n, (2, m))
        half = m // 2
        assert hook(hook(np.arange(n), x[:half], y[:half]), x[half:], y[half:]).tolist() == brute.components(n, zip(x.tolist(), y.tolist(), strict=True))


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    frame = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(frame, Scratch(spark, "test"), "c").collect()}
    nodes = sorted({x for a, b in links for x in (a, b) if a != b})
    at = {x: i for i, x in enumerate(nodes)}
    roots = brute.components(len(nodes), [(at[a], at[b]) for a, b in links if a != b])
    assert got == {x: nodes[r] for x, r in zip(nodes, roots, strict=True)}


def test_longest_repeats(spark, docs, documents, nothing):
    window, longest = 7, {}
    words = [(i, brute.WORD.findall(t or "")) for i, t in documents if i is not None]
    length = window
    while True:
        owners = {}
        for i, w in words:
            for s in range(len(w) - length + 1):
                owners.setdefault(tuple(w[s:s + length]), set()).add(i)
        hit = {i for o in owners.values() if len(o) > 1 for i in o}
        if not hit:
            break
        longest |= dict.fromkeys(hit, length)
        length *= 2
    assert length > 4 * window
    assert {r["doc_id"]: r["longest"] for r in substring_dedup.longest_repeats(docs, window=window).collect()} == longest
    assert substring_dedup.longest_repeats(nothing).isEmpty()


def test_copies_of_a_text_are_dealt_over_all_tasks(spark):
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 3 == 0, "a text that a third of all rows have").when(F.col("id") % 3 == 1, "").otherwise(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" x y z"))).alias("text"))
    own = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        held = sorted(r["count"] for r in jaccard._chained(rows.repartition(7), 3, Fraction(9, 10), frozenset()).groupBy(F.spark_partition_id().alias("p")).count().collect())
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(held) == 16 and held[-1] < 2 * held[8]
