import gzip
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pagewright.llm import chat, mixing, packing, quality, queries, sharding, warc

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_mixing_repeats_rows_with_the_right_mean(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("x" * 9).alias("text"), F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 2 == 0, "small").alias("source"))
    out = mixing.mix_sources(docs, {"big": 1.0, "small": 2.0}, seed=4, other=1.0)
    n = dict(out.groupBy("source").count().collect())
    for source, share in (("big", 0.25), ("small", 0.5), (None, 0.25)):
        assert abs(n[source] / 30_000 - share) < 0.01
    copies = Counter(r["n"] for r in out.where("source = 'small'").groupBy("doc_id").agg(F.count("*").alias("n")).collect())
    assert abs(copies[3] / 5_000 - 3 ** 3 * np.exp(-3) / 6) < 0.02
    assert out.groupBy("doc_id").agg(F.countDistinct("copy").alias("a"), F.max("copy").alias("b"), F.max("n_copies").alias("c")).where("a <> b + 1 or a <> c").isEmpty()


def test_mixing_of_odd_tables(docs, nothing):
    out = mixing.mix_sources(docs, {"s0": 1.0, "s1": 0.0, "absent": 5.0}, epochs=40.0)
    assert out.columns == [c for c in docs.columns if c not in mixing.ADDED] + mixing.ADDED
    assert out.where("source = 's1'").isEmpty() and not out.where("source is null").isEmpty()
    assert out.agg(F.max("rate")).first()[0] > mixing.PART
    assert mixing.mix_sources(nothing, {"s0": 1.0}).isEmpty()
    assert mixing.mix_sources(docs, {}, other=0.0).isEmpty()
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"s0": -1.0})


def test_mixing_is_the_same_again(docs):
    a, b = (sorted((r["doc_id"] or -1, r["copy"]) for r in mixing.mix_sources(docs.repartition(n), {"s0": 3.0}).collect()) for n in (1, 5))
    assert a == b


def packed(docs, **options):
    return packing.pack(docs, VOCABULARY, **options).toPandas()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_packing(docs, documents, tokenizer, nothing):
    for options in ({}, {"block": 3000}, {"length": 256, "block": 500}):
        out = packed(docs, **options)
        length = options.get("length", 2048)
        used = out.groupby("sequence_id")["length"].sum()
        assert used.max() <= length
        tails = out["sequence_id"].map(lambda q: q >> 33).nunique()  # the last window of each partition is what is left
        assert sum(sorted(length - u for u in used)[:-tails]) < 0.2 * used.sum()  # most of these texts have no sentences
        for _, s in out.sort_values("offset").groupby("sequence_id"):
            assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]]
        want = Counter()
        for i, t in documents:
            want[i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1] += 1
        starts = out[out["start"] == 0]
        assert Counter((None if i != i else int(i), int(n)) for i, n in zip(starts["doc_id"], starts["doc_tokens"])) == want
        assert (out["length"] > 0).all() and out["length"].sum() == sum(n * c for (_, n), c in want.items())
        alone = {i for i, c in Counter(i for i, _ in documents).items() if c == 1 and i is not None}
        texts = dict(documents)
        for i, s in out[out["doc_id"].isin(alone)].sort_values("start").groupby("doc_id"):
            ids = np.array(tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [1], "<u4")
            assert s["start"].tolist() == [0, *s["length"].cumsum()[:-1]]
            assert [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(s["start"], s["length"])] == s["ids_crc32"].tolist()
    assert packing.pack(nothing, VOCABULARY).count() == 0


def test_tokens_are_those_of_the_file(tokenizer):
    import pyarrow as pa

    odd = ["", " ", "a  b", "a\n b", "x <|endoftext|> y", "<|endoftext|>", "é ö　z", "a b c", " lead", "tail ", "a ​ b", "1 2½ ٣ x", "\n\na b", "don't it's 'll x", "a\n", "a \x1cb", "a\x85 b", "😀 x"]
    tokens = packing.Tokens(VOCABULARY)
    for _ in range(2):
        stream, sizes = tokens.stream(pa.array(odd))
        at = 0
        for text, n in zip(odd, sizes, strict=True):
            assert stream[at:at + n].tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1], text
            at += n


def test_cuts_are_the_best_ones():
    rng = np.random.default_rng(6)
    for _ in range(60):
        n, length = int(rng.integers(1, 40)), int(rng.integers(6, 20))
        ends = np.unique(np.append(rng.permutation(np.arange(1, n + 1))[:n // 2], np.arange(5, n + 1, 5)))
        ends = np.unique(np.append(ends, n))
        price = rng.choice([0.0, 2.0, 9.0], len(ends))
        best, back = {0: 0.0}, {}
        for e, p in zip(ends.tolist(), price.tolist(), strict=True):
            best[e], back[e] = min((best[i] + p + length - (e - i), i) for i in best if e - length <= i < e)
        chosen = packing.cut(ends, price, length)
        edges = [0, *ends[chosen].tolist()]
        assert edges[-1] == n and max(b - a for a, b in zip(edges, edges[1:])) <= length
        assert sum(length - (b - a) for a, b in zip(edges, edges[1:])) + price[chosen].sum() == pytest.approx(best[n])


TURNS = "conv_id long, turn long, role string, text string, place int, hash_a long, n_turns int"


def test_chat(spark):
    def talk(conv, *said):
        return [(conv, k, "user" if k % 2 == 0 else "assistant", x) for k, x in enumerate(said)]

    turns = (talk(1, "a") + talk(2, "a", "b") + talk(3, "a", "b", "c") + talk(4, "a", "x") + talk(5, "a", "x") + talk(6, "b") + talk(7, "a", None) + talk(8, "a", "")
             + [(9, 0, None, "<|im_end|>"), (9, 0, None, "<|im_end|>"), (9, None, "user", "first"), (10, 0, None, "<|im_end|>"), (None, 0, "user", "a")] + talk(11, *["long " * 50] * 60) + talk(12, *["long " * 50] * 59))
    frame = spark.createDataFrame([(*t, 1, 2, 3) for t in turns], TURNS)
    assert sorted(tuple(r) for r in chat.collapse_and_render(frame).collect()) == sorted(brute.maximal(turns))
    assert chat.collapse_and_render(frame.limit(0)).isEmpty()


def test_quality_learns_and_leaves_no_row_out(spark, docs, documents):
    sf = "/root/testdata/sf0.01"
    table = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    model = quality.fit(table("documents"), table("labels"))
    out = quality.score(table("documents"), model).join(table("labels"), "doc_id").where("held_out").toPandas()
    good, bad = out[out["quality"] == 1]["score"], out[out["quality"] == 0]["score"]
    assert np.mean([(good > x).mean() for x in bad]) > 0.95
    assert (good >= 0.3).mean() > 0.98
    odd = quality.score(docs, model).toPandas()
    assert len(odd) == len(documents) and odd["score"].between(0, 1).all()
    assert (odd["predicted"] == (odd["score"] >= 0.3)).all()
    for i, held in odd[["doc_id", "held_out"]].dropna().itertuples(index=False):
        assert held == (zlib.crc32(str(int(i)).encode()) % 5 == 0)
    assert quality.keep(docs, model).count() == odd["predicted"].sum()
    assert quality.keep(docs, model).columns == docs.columns


def test_quality_without_labels(spark, docs, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none)
    assert {r["score"] for r in quality.score(docs, model).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    assert quality.score(docs, quality.fit(docs, one)).where("score < 0.9").isEmpty()
    assert quality.score(nothing, model).isEmpty() and quality.keep(nothing, model).isEmpty()


def test_scores_are_those_worked_out_plainly(monkeypatch, documents):
    """However texts are cut, also within a pair of words; of texts without white space, with nothing, of letters beyond 16 bits."""
    rng = np.random.default_rng(0)
    table = rng.standard_normal(quality.BUCKETS)
    texts = ["one two two three " * 40, "", " ", "é" * 300, "a", "\U0001f600\x01b b b", *(t or "" for _, t in documents[::3])]
    want = [brute.quality(t, table, 0.25) for t in texts]
    for part in (1 << 19, 50, 7, 1):
        monkeypatch.setattr(quality, "PART", part)
        assert 1 / (1 + np.exp(-(quality.logits(texts, table) + 0.25))) == pytest.approx(want)
        ids, counts = quality.features(texts[0])
        assert quality.logits(texts[:1], table)[0] == pytest.approx((table[ids] * counts).sum() / counts.sum())


def test_query_scores_as_plainly(spark, sf_dir):
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    model = quality.fit(table("documents"), table("labels"))
    text = dict(table("documents").select("doc_id", "text").collect())
    got = queries.QUERIES["op4_quality_classifier"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    for r in got:
        assert r["score"] == pytest.approx(brute.quality(text[r["doc_id"]] or "", *model))
        assert r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_an_id_with_two_labels_or_texts(spark):
    docs = spark.createDataFrame([(i, f"{'good fine' if i % 2 else 'bad poor'} {i}") for i in range(60)] + [(1, "zzz bad poor")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(i, 0) for i in range(1, 60, 2)] + [(None, 1), (3, None), (5, 7)], "doc_id long, quality int")
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs.where("text not like 'zzz%'"), quality.fit(docs, labels)).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if not i % 2)


def check_shards(out, documents, shards, slack):
    assert len(out) == len(documents)
    texts = defaultdict(list)
    for i, t in documents:
        texts[i].append(t or "")
    for r in out.itertuples():
        i = None if r.doc_id != r.doc_id else r.doc_id
        assert any(len(t.encode()) + 1 == r.size and zlib.crc32(t.encode()) == r.text_crc32 for t in texts[i])
    assert set(out["law"]) <= {"bytes"} and out["grown_shard"].isna().all()
    for _, s in out.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    per = out.groupby("shard")["size"].sum().reindex(range(shards), fill_value=0)
    mean = out["size"].sum() / shards
    assert per.max() - mean <= slack and per.index.max() < shards
    for _, group in out.groupby("text_crc32"):
        assert group["shard"].nunique() == 1 or group["size"].sum() > 0.1 * mean


def test_query_shards_as_counted_plainly(spark, sf_dir):
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    largest = max(len((t or "").encode()) + 1 for _, t in table)
    out = queries.QUERIES["op9_shard_by_bytes"](spark, sf_dir).toPandas()
    check_shards(out, table, 16, largest + 0.06 * out["size"].sum() / 16)
    assert sorted(out["doc_id"]) == sorted(i for i, _ in table)


def test_pairs_of_equal_texts_stay_together(spark):
    rows = [(i, f"text {i // 2} " + "x" * (i // 2 % 700)) for i in range(6000)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).toPandas()
    assert out.groupby("text_crc32")["shard"].nunique().max() == 1
    check_shards(out, rows, 16, 0.02 * out["size"].sum() / 16)


@pytest.mark.parametrize("shards", [16, 3])
def test_sharding(docs, documents, nothing, shards):
    out = sharding.shard_by_bytes(docs, shards, bucket_rows=2).toPandas().rename(columns={"size": "size"})
    out.columns = [str(c) for c in out.columns]
    frame = out.rename(columns={"size": "size"})
    check_shards(frame, documents, shards, frame["size"].max())
    assert sharding.shard_by_bytes(nothing, shards).count() == 0


def test_sharding_cuts_a_text_that_most_rows_have(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(3000)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).toPandas()
    check_shards(out, rows, 16, 40)
    per = out.groupby("shard")["size"].sum()
    assert per.max() / per.mean() < 1.01


def test_warc(spark):
    html = "<html><head><title>T &amp; U</title><script>var x = '</p>';</script></head><body><!-- no --><p>One <b>two</b><br>three&nbsp;&#x41;</p><div>é</div></body></html>"
    pages = spark.createDataFrame([(1, "http://a/", html), (2, None, None), (3, "http://c/", ""), (None, "http://d/", "x"), (1, "http://a/", html)], "page_id long, url string, html string").withColumn("block", F.lit(1)).withColumn("date", F.lit(2))
    records = warc.responses(pages, date="2024-01-01T00:00:00Z")
    out = warc.derivatives(records).toPandas()
    assert len(out) == 10 and out["record_id"].nunique() == 8
    source = {r["record_id"]: r for r in records.collect()}
    assert all(len(x) == len("<urn:uuid:00000000-0000-0000-0000-000000000000>") for x in source)
    for r in out.itertuples():
        head, _, payload = bytes(source[r.refers_to]["block"]).partition(b"\r\n\r\n")
        assert r.content_length == len(r.block) and r.block_digest == warc.digest(r.block)
        if r.type == "metadata":
            told = dict(x.split(": ", 1) for x in r.block.decode().strip().split("\r\n"))
            assert told["source-payload-digest"] == r.payload_digest == warc.digest(payload)
            assert told["source-header-content-type"] == "text/html; charset=utf-8" and told["conversion-record-id"] in set(out["record_id"])
    text = {r.page_id: r.block.decode() for r in out[out["type"] == "conversion"].dropna(subset=["page_id"]).itertuples()}
    assert text == {1: "T & U\nOne two\nthree A\né", 2: "", 3: ""}
    assert warc.derivatives(records.limit(0)).isEmpty()


def test_query_gives_records_of_the_texts_that_a_parser_reads(spark, sf_dir, tmp_path):
    """Written as WARC, read again by their lengths; texts by the library's parser of HTML."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    out = queries.QUERIES["op10_warc_derivatives"](spark, sf_dir)
    text = {r["page_id"]: bytes(r["block"]).decode() for r in out.where("type = 'conversion'").collect()}
    assert text == {i: brute.page_text(r["html"] or "") for i, r in pages.items()}
    warc.write_warc(out, str(tmp_path / "out"))
    records = [x for r in spark.read.parquet(str(tmp_path / "out")).collect() for x in brute.warc_records(gzip.decompress(r["warc"]))]
    kinds = {h["WARC-Record-ID"]: (h, b) for h, b in records}
    assert len(kinds) == len(records) == 2 * len(pages)
    for h, block in records:
        assert h["WARC-Block-Digest"] == warc.digest(block)
        if h["WARC-Type"] == "metadata":
            told = dict(x.split(": ", 1) for x in block.decode().strip().split("\r\n"))
            other, _ = kinds[told["conversion-record-id"]]
            assert other["WARC-Type"] == "conversion" and other["WARC-Refers-To"] == h["WARC-Refers-To"] and other["WARC-Target-URI"] == h["WARC-Target-URI"]
            assert told["source-payload-digest"] in {warc.digest((r["html"] or "").encode()) for r in pages.values()}


@pytest.mark.parametrize("piece", ["<p ", "<script ", "<!-- ", "</script ", "<", "&#", "&#0", "&#9", "&#x0", "<script></style >", " \n", "<style>a</style "])
def test_hostile_pages_take_linear_time(piece):
    import time

    took = []
    for n in (50_000, 200_000):
        began = time.monotonic()
        warc.plain_text(piece * n)
        took.append(time.monotonic() - began)
    assert took[1] < 8 * max(took[0], 0.1)


def test_tags_at_the_end_and_numbers_of_no_character():
    assert warc.plain_text("a <b") == "a" and warc.plain_text("a > b &gt") == "a > b >" and warc.plain_text("1 < 2") == "1 < 2"
    assert warc.plain_text("&#" + "0" * 5000 + "65; &#" + "9" * 5000 + "; &#x" + "f" * 5000 + ";") == "A \ufffd \ufffd"
    assert warc.plain_text("a\0>") == "a\ufffd>"


def test_warc_files(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nX-A: b\r\n\r\n<p>caf\xe9</p>"
    whole = b"".join(gzip.compress(warc.record_bytes(kind, f"<urn:uuid:{kind}>", "http://a/", "2024-01-01T00:00:00Z", "application/http; msgtype=response", block)) for kind in ("warcinfo", "response"))
    (tmp_path / "in.warc.gz").write_bytes(whole)
    records = warc.read_responses(spark, str(tmp_path / "in.warc.gz"))
    out = warc.derivatives(records)
    assert {(r["type"], bytes(r["block"]).decode().split("\r\n")[0]) for r in out.collect()} >= {("conversion", "café")}
    warc.write_warc(out, str(tmp_path / "out"))
    written = b"".join(bytes(r["warc"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    again = list(warc.parse(written))
    assert sorted(h["WARC-Type"] for h, _ in again) == ["conversion", "metadata"]
    assert all(h["WARC-Refers-To"] == "<urn:uuid:response>" and h["WARC-Block-Digest"] == warc.digest(b) for h, b in again)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_what_sql_gives(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "clients", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.select(*columns).fetchall(), key=repr)


@pytest.mark.parametrize("name,plain", [("op5_substring_dedup", brute.substring), ("op7_jaccard_join", brute.jaccard), ("op8_exact_dedup", brute.exact_groups)])
def test_query_gives_what_brute_force_gives(spark, sf_dir, name, plain):
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES[name](spark, sf_dir).collect())) == sorted(plain(table))


def test_sequences_and_hashes_of_queries(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert queries.QUERIES["op2_pack_sequences"](spark, sf_dir).where("start = 0").count() == n
    assert queries.QUERIES["op6_embedding_dedup"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


def test_sequences_of_the_query_against_the_library(spark, sf_dir, tokenizer):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    rows = queries.QUERIES["op2_pack_sequences"](spark, sf_dir).collect()
    windows, whole, elsewhere = defaultdict(list), defaultdict(list), 0
    for r in rows:
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        windows[r["sequence_id"]].append((r["offset"], r["length"], r))
        whole[r["doc_id"]].append((r["start"], r["length"]))
    for i, spans in whole.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(ids[i])
    assert set(whole) == set(ids)
    for pieces in windows.values():
        last = max(pieces)[2]
        end = last["start"] + last["length"]
        token = tokenizer.decode([ids[last["doc_id"]][end - 1]])
        elsewhere += end < last["doc_tokens"] and not (token.rstrip().endswith((*".!?…。！？।",)) or "\n" in token)
    assert sum(len(x) for x in ids.values()) > 0.94 * 2048 * len(windows) and elsewhere <= 0.05 * len(windows)
