"""One query for each operator of this subpackage, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embedding_dedup, exact_dedup, golden, jaccard, mixing, packing, quality, search, sharding, substring_dedup, warc

WEIGHTS = {f"src{i}": 1.0 + i % 4 for i in range(20)}
CRAWLED = "2024-01-01T00:00:00Z"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), WEIGHTS, seed=1).select("doc_id", "text", "lang", "source", "n_chars", "n_copies", "copy")


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(table(spark, sf_dir, "embeddings"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, similarity=Fraction(9, 10))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 16)


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages"), date=CRAWLED))


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), vocabulary()), vocabulary())
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_golden_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = golden.golden_records(table(spark, sf_dir, "clients"))
    return found.withColumn("balance_cents", F.floor(100 * F.col("balance") + 0.5).cast("long")).drop("balance")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_pack_sequences, op3_chat_format, op4_quality_classifier, op5_substring_dedup,
                            op6_embedding_dedup, op7_jaccard_join, op8_exact_dedup, op9_shard_by_bytes, op10_warc_derivatives, op11_bpe_round_trip,
                            op12_golden_records, op13_ranked_search)}

_WEIGHTS_SQL = ", ".join(f"('{k}', {v})" for k, v in WEIGHTS.items())

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": f"""
        WITH given(name, weight) AS (VALUES {_WEIGHTS_SQL}, ('*', 1.0)),
        rows AS (SELECT d.*, coalesce(g.name, '*') AS grp,
                        md5('1/' || coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))) AS key,
                        row_number() OVER () AS row_no
                 FROM documents d LEFT JOIN given g ON d.source = g.name AND g.name <> '*'),
        sizes AS (SELECT grp, sum(length(coalesce(text, '')) + 1)::DOUBLE AS size FROM rows GROUP BY grp),
        rates AS (SELECT grp, (SELECT sum(size) FROM sizes) * weight / (SELECT sum(weight) FROM sizes JOIN given ON name = grp) / size AS rate
                  FROM sizes JOIN given ON name = grp),
        parts AS (SELECT grp, rate, greatest(ceil(rate / 16.0), 1)::BIGINT AS parts FROM rates),
        bounds AS (SELECT grp, k, exp(k * ln(rate / parts) - rate / parts - lgamma(k + 1)) AS p FROM parts, range(0, 97) t(k)),
        cdf AS (SELECT grp, k, sum(p) OVER (PARTITION BY grp ORDER BY k) AS bound FROM bounds),
        draws AS (SELECT row_no, r.grp, ('0x' || substr(md5(key || '/' || j), 1, 12))::BIGINT / 281474976710656.0 AS u
                  FROM rows r JOIN parts p ON r.grp = p.grp, range(1, 65) t(j) WHERE j <= p.parts),
        counts AS (SELECT row_no, count(*) AS n_copies FROM draws d JOIN cdf c ON d.grp = c.grp AND d.u >= c.bound GROUP BY row_no)
        SELECT doc_id, text, lang, source, n_chars, n_copies::INT AS n_copies, copy::INT AS copy
        FROM rows JOIN counts USING (row_no), range(0, 2000) t(copy) WHERE copy < n_copies""",
    "op3_chat_format": """
        WITH turns AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                              row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS place
                       FROM conversations WHERE conv_id IS NOT NULL),
        keyed AS (SELECT conv_id, place, string_agg(md5(role || chr(0) || text), '') OVER (PARTITION BY conv_id ORDER BY place) AS so_far,
                         count(*) OVER (PARTITION BY conv_id) AS n_turns FROM turns),
        prefixes AS (SELECT so_far, max(n_turns) AS longest, min(CASE WHEN place = n_turns THEN conv_id END) AS conv_id,
                            count(*) FILTER (WHERE place = n_turns) AS n_copies, max(place) AS place FROM keyed GROUP BY so_far)
        SELECT t.conv_id, count(*) AS n_turns, any_value(p.n_copies) AS n_copies,
               string_agg('<|im_start|>' || role || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY t.place) AS rendered
        FROM turns t JOIN prefixes p ON t.conv_id = p.conv_id AND p.longest = p.place GROUP BY t.conv_id""",
    "op8_exact_dedup": """
        WITH rows AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normal FROM documents),
        groups AS (SELECT normal, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY normal)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(normal) AS text_sha256 FROM rows JOIN groups USING (normal)""",
    "op5_substring_dedup": r"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM docs),
        windows AS (SELECT doc_id, s, md5(array_to_string(words[s:s + 49], ' ')) AS w FROM starts),
        firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
        gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS place FROM windows JOIN firsts USING (w) WHERE first < doc_id),
        every AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM docs),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM every ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
        SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)""",
    "op6_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS one, b.vec_id AS two FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT one, two FROM links UNION SELECT r.one, l.two FROM reach r JOIN links l ON r.two = l.one),
        least AS (SELECT one, min(two) AS two FROM reach GROUP BY one), n AS (SELECT one, count(*) AS n FROM links GROUP BY one)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(two, vec_id)) AS component_id, vec_id <= coalesce(two, vec_id) AS kept
        FROM embeddings LEFT JOIN least ON vec_id = least.one LEFT JOIN n ON vec_id = n.one""",
    "op7_jaccard_join": r"""
        WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        sets AS (SELECT doc_id, CASE WHEN len(words) >= 3 THEN list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')))
            WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS items FROM docs),
        every AS (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM sets),
        links AS (SELECT a.doc_id AS one, b.doc_id AS two FROM every a JOIN every b ON a.item = b.item AND a.doc_id <> b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        reach AS (SELECT one, two FROM links UNION SELECT r.one, l.two FROM reach r JOIN links l ON r.two = l.one),
        least AS (SELECT one, min(two) AS two FROM reach GROUP BY one)
        SELECT doc_id, len(items)::BIGINT AS n_shingles, least(doc_id, coalesce(two, doc_id)) AS component_id FROM sets LEFT JOIN least ON doc_id = one""",
    "op12_golden_records": r"""
        WITH r AS (SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at, coalesce(list_position(['crm', 'web', 'store', 'partner'], source), 5) AS level, nation_id, balance,
                CASE WHEN NOT regexp_full_match(name, '[\x20\x09-\x0D]*') THEN name END AS name, CASE WHEN NOT regexp_full_match(email, '[\x20\x09-\x0D]*') THEN email END AS email,
                CASE WHEN NOT regexp_full_match(segment, '[\x20\x09-\x0D]*') THEN segment END AS segment, CASE WHEN NOT regexp_full_match(city, '[\x20\x09-\x0D]*') THEN city END AS city FROM clients),
        f AS (SELECT *, coalesce(updated_at < max(updated_at) OVER (PARTITION BY cluster_id) - INTERVAL 1440 HOUR, true) AS stale, (city IS NOT NULL)::INT + (nation_id IS NOT NULL)::INT AS given FROM r),
        s AS (SELECT *, first_value(segment) OVER (PARTITION BY cluster_id ORDER BY segment IS NULL, updated_at DESC NULLS LAST, level, client_id) AS chosen FROM f),
        best AS (SELECT cluster_id, count(*) AS n_records, count_if(stale) AS n_stale,
                first({'v': name, 'c': client_id} ORDER BY length(name) DESC, stale, level, updated_at DESC NULLS LAST, client_id) FILTER (name IS NOT NULL) AS n,
                first({'v': email, 'c': client_id} ORDER BY stale, level, updated_at DESC NULLS LAST, client_id) FILTER (email IS NOT NULL) AS e,
                first({'v': segment, 'c': client_id} ORDER BY updated_at DESC NULLS LAST, level, client_id) FILTER (segment IS NOT NULL) AS g,
                first({'v': balance, 'c': client_id} ORDER BY segment IS DISTINCT FROM chosen, updated_at DESC NULLS LAST, level, client_id) FILTER (balance IS NOT NULL) AS b,
                first({'city': city, 'nation': nation_id, 'c': client_id} ORDER BY given DESC, stale, level, updated_at DESC NULLS LAST, client_id) FILTER (given > 0) AS a FROM s GROUP BY cluster_id)
        SELECT cluster_id, n_records, n_stale::BIGINT AS n_stale, n.v AS name, e.v AS email, g.v AS segment, a.city AS city, a.nation AS nation_id, floor(100 * b.v + 0.5)::BIGINT AS balance_cents,
            n.c AS name_from, e.c AS email_from, g.c AS segment_from, b.c AS balance_from, a.c AS address_from FROM best""",
    "op13_ranked_search": r"""
        WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
        known AS (SELECT *, len(terms) AS n FROM docs WHERE len(terms) > 0), totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM known),
        asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
        tf AS (SELECT row_no, doc_id, n, term, count(*) AS tf FROM (SELECT row_no, doc_id, n, unnest(terms) AS term FROM known) SEMI JOIN asked USING (term) GROUP BY ALL),
        weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
        scores AS (SELECT item_id, row_no, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
            FROM asked JOIN weights USING (term) JOIN tf USING (term), totals GROUP BY ALL)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10""",
}
