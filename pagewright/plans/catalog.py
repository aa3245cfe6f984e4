"""A query for each operator over the driver's tables, and the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, omml, text
from ..operators import checks, chunking, formatting, lookups
from ..operators.counters import Counters
from ..scratch import Scratch, is_there
from ..sources import chunks, docx, members
from ..streaming import attempts
from . import documents, samples
from .adapters import edited_lines, lines, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


LINES = """lines AS (SELECT doc_id, (i - 1)::INT AS line_ord, lpad(upper(to_hex(i - 1)), 8, '0') AS para_id, parts[i] AS text
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), range(1, 100000) t(i) WHERE i <= len(parts))"""
PACKED = f"""WITH RECURSIVE {LINES}, items AS (SELECT *, length(text) AS n FROM lines),
    packed AS (
        SELECT doc_id, line_ord, para_id, n, 0 AS chunk, CASE WHEN n > 1000 THEN 1 ELSE 0 END AS idx, CASE WHEN n > 1000 THEN 0 ELSE n END AS held, n <= 1000 AS open, 0 AS line
        FROM items WHERE line_ord = 0
        UNION ALL
        SELECT i.doc_id, i.line_ord, i.para_id, i.n,
               CASE WHEN i.n > 1000 AND p.open OR p.open AND p.held + i.n > 1000 THEN p.idx + 1 ELSE p.idx END,
               CASE WHEN i.n > 1000 THEN p.idx + CASE WHEN p.open THEN 2 ELSE 1 END WHEN p.open AND p.held + i.n > 1000 THEN p.idx + 1 ELSE p.idx END,
               CASE WHEN i.n > 1000 THEN 0 WHEN p.open AND p.held + i.n > 1000 THEN i.n ELSE p.held + i.n END, i.n <= 1000,
               CASE WHEN i.n > 1000 OR NOT p.open OR p.held + i.n > 1000 THEN 0 ELSE p.line + 1 END
        FROM packed p JOIN items i ON i.doc_id = p.doc_id AND i.line_ord = p.line_ord + 1)"""


@query(f"{PACKED} SELECT doc_id, line_ord, para_id, n::BIGINT AS n_chars, chunk::INT AS chunk_idx, line::INT AS line_no FROM packed")
def chunk_pack(spark, sf_dir):
    """Lines of documents in chunks of at most 1,000 characters."""
    items = lines(spark, sf_dir).withColumn("n_chars", F.length("text").cast("long")).drop("text")
    return chunking.pack_chunks(items, ["doc_id"], "line_ord", "n_chars")


@query(f"{PACKED} SELECT doc_id, chunk::INT AS chunk_idx, count(*) AS n_lines, sum(n)::BIGINT AS n_chars FROM packed GROUP BY ALL")
def chunk_sizes(spark, sf_dir):
    return chunking.chunk_sizes(chunk_pack(spark, sf_dir), ["doc_id"], "n_chars")


RANKED = """ranked AS (SELECT conv_id, role, cnt, first_ord, row_number() OVER (PARTITION BY conv_id ORDER BY cnt DESC, first_ord) - 1 AS rank
    FROM (SELECT conv_id, role, count(*) AS cnt, min(turn) AS first_ord FROM conversations WHERE role IS NOT NULL GROUP BY ALL))"""


@query(f"WITH {RANKED} SELECT conv_id, role, cnt, first_ord, 'F' || rank AS cat_id, rank = 0 AS is_baseline FROM ranked")
def category_rank(spark, sf_dir):
    return formatting.rank_categories(table(spark, sf_dir, "conversations"), ["conv_id"], "role", "turn")


@query(f"WITH {RANKED} SELECT conv_id, role AS baseline, cnt FROM ranked WHERE rank = 0")
def baseline_per_doc(spark, sf_dir):
    return category_rank(spark, sf_dir).where("is_baseline").select("conv_id", F.col("role").alias("baseline"), "cnt")


@query("""WITH marked AS (SELECT user_id, event_type, ts, event_id, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    islands AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM marked)
    SELECT user_id, island::BIGINT AS island, any_value(event_type) AS event_type, count(*) AS n_runs FROM islands GROUP BY user_id, island""")
def run_merge(spark, sf_dir):
    return formatting.merge_runs(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"]).select("user_id", "island", F.col("key").alias("event_type"), "n_runs")


TAGGED = f"""{RANKED},
    runs AS (SELECT c.conv_id, c.turn, coalesce(c.text, '') AS text, r.rank, 'F' || r.rank AS cat_id FROM conversations c JOIN ranked r ON c.conv_id = r.conv_id AND c.role = r.role WHERE coalesce(c.text, '') <> ''),
    marked AS (SELECT *, CASE WHEN lag(rank) OVER (PARTITION BY conv_id ORDER BY turn) = rank THEN 0 ELSE 1 END AS new FROM runs),
    islands AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM marked),
    merged AS (SELECT conv_id, island, any_value(rank) AS rank, string_agg(text, '' ORDER BY turn) AS text FROM islands GROUP BY conv_id, island),
    tagged AS (SELECT conv_id, string_agg(CASE WHEN rank = 0 THEN text ELSE '‹F' || rank || ':fmt›' || text || '‹/›' END, '' ORDER BY island) AS text FROM merged GROUP BY conv_id)"""


@query(f"WITH {TAGGED} SELECT conv_id, text FROM tagged")
def tagged_text(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    runs = turns.join(category_rank(spark, sf_dir).select("conv_id", "role", "cat_id", "is_baseline"), ["conv_id", "role"]).withColumn("hint", F.lit("fmt"))
    return formatting.tag_text(runs, ["conv_id"], "turn")


TAG_LINE = "concat('<b=1,i=', doc_id % 3, '>', text, '</b=1,i=', doc_id % 3, '> <u>', '<s,f=', lang, '>x</s,f=', lang, '></i=9> <i=9>y</i=8>')"


_PAIR = "<[fisbzchuv,=A-Za-z0-9_]+>[^<]*</[fisbzchuv,=A-Za-z0-9_]+>"


@query(f"""WITH pairs AS (SELECT doc_id, unnest(regexp_extract_all({TAG_LINE}, '{_PAIR}')) AS pair FROM documents),
    items AS (SELECT doc_id, unnest(string_split(regexp_extract(pair, '^<([^>]*)>', 1), ',')) AS item FROM pairs WHERE regexp_extract(pair, '^<([^>]*)>', 1) = regexp_extract(pair, '</([^>]*)>$', 1))
    SELECT doc_id, string_agg(DISTINCT item, '|' ORDER BY item) AS tag_types FROM items WHERE contains(item, '=') GROUP BY doc_id""")
def tag_types(spark, sf_dir):
    line = F.expr(TAG_LINE)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.tag_types(line), "|").alias("tag_types")).where("tag_types <> ''")


@query("""WITH tokens AS (SELECT page_id, regexp_extract_all(html, '</?[fisbzchuv,=A-Za-z0-9_]*>') AS tokens FROM pages),
    folded AS (SELECT page_id, list_reduce(list_transform(tokens, lambda x: {'name': regexp_replace(x, '^</?|>$', '', 'g'), 'closes': starts_with(x, '</'), 'open': []::VARCHAR[], 'extra': 0, 'wrong': 0}),
        lambda s, x: {'name': '', 'closes': false,
            'open': CASE WHEN x.closes THEN s.open[1:greatest(len(s.open) - 1, 0)] ELSE list_append(s.open, x.name) END,
            'extra': s.extra + CASE WHEN x.closes AND len(s.open) = 0 THEN 1 ELSE 0 END,
            'wrong': s.wrong + CASE WHEN x.closes AND len(s.open) > 0 AND s.open[len(s.open)] <> x.name THEN 1 ELSE 0 END},
        {'name': '', 'closes': false, 'open': []::VARCHAR[], 'extra': 0, 'wrong': 0}) AS s FROM tokens)
    SELECT page_id, s.extra::BIGINT AS n_extra, s.wrong::BIGINT AS n_mismatched, len(s.open)::BIGINT AS n_unclosed FROM folded""")
def tag_stack(spark, sf_dir):
    faults = table(spark, sf_dir, "pages").select("page_id", text.tag_faults(F.col("html")).alias("f"))
    of = lambda rule: F.size(F.filter("f", lambda x: x["rule"] == rule)).cast("long")
    return faults.select("page_id", of("TAG_EXTRA_CLOSE").alias("n_extra"), of("TAG_MISMATCH").alias("n_mismatched"), of("TAG_UNCLOSED").alias("n_unclosed"))


EDITED = f"""{LINES}, spots AS (SELECT *, doc_id * 7 + line_ord AS spot, 'chunk_' || doc_id || '.md' AS file_name, '[' || para_id || '] ' || text AS plain,
        '[' || para_id || '] <b=1,i=2>' || text || '</b=1,i=2>' AS tags FROM lines),
    origin AS (SELECT file_name, line_ord AS line_no, CASE WHEN spot % 5 = 0 THEN tags ELSE plain END AS line FROM spots WHERE doc_id % 29 <> 11),
    chunks AS (SELECT file_name, line_ord AS line_no, CASE WHEN spot % 11 = 3 THEN text WHEN spot % 13 = 4 THEN '[0000FFFF] ' || text WHEN spot % 17 = 5 THEN '[' || para_id || '] <b>x</i> </u> <s>'
        WHEN spot % 10 = 0 THEN plain WHEN spot % 5 = 0 THEN tags ELSE plain END AS line FROM spots WHERE (spot % 19 <> 6 OR line_ord = 0) AND doc_id % 23 <> 7),
    names AS (SELECT coalesce(a.file_name, b.file_name) AS file_name, a.file_name IS NOT NULL AS in_left, b.file_name IS NOT NULL AS in_right
        FROM (SELECT DISTINCT file_name FROM chunks) a FULL JOIN (SELECT DISTINCT file_name FROM origin) b ON a.file_name = b.file_name),
    pairs AS (SELECT coalesce(c.file_name, o.file_name) AS file_name, coalesce(c.line_no, o.line_no) AS line_no, c.line AS mine, o.line AS theirs
        FROM chunks c FULL JOIN origin o ON c.file_name = o.file_name AND c.line_no = o.line_no WHERE coalesce(c.file_name, o.file_name) IN (SELECT file_name FROM names WHERE in_left AND in_right)),
    ids AS (SELECT *, upper(nullif(regexp_extract(mine, '^\\[([0-9A-Fa-f]{{8}})\\]', 1), '')) AS my_id, upper(nullif(regexp_extract(theirs, '^\\[([0-9A-Fa-f]{{8}})\\]', 1), '')) AS their_id FROM pairs),
    good AS (SELECT * FROM ids WHERE mine IS NOT NULL AND theirs IS NOT NULL AND my_id IS NOT NULL AND their_id IS NOT NULL),
    faults AS (
        SELECT file_name, line_no, CASE WHEN mine IS NULL THEN 'CHUNK_LINE_MISSING' WHEN theirs IS NULL THEN 'ORIGIN_LINE_MISSING' WHEN my_id IS NULL THEN 'CHUNK_NO_ID' ELSE 'ORIGIN_NO_ID' END AS rule, NULL AS detail
        FROM ids WHERE mine IS NULL OR theirs IS NULL OR my_id IS NULL OR their_id IS NULL
        UNION ALL SELECT file_name, line_no, 'ID_MISMATCH', my_id || ' ' || their_id FROM good WHERE my_id <> their_id
        UNION ALL SELECT file_name, line_no, unnest(['TAG_MISMATCH', 'TAG_EXTRA_CLOSE', 'TAG_UNCLOSED']), unnest(['i b', 'u', 's']) FROM good WHERE contains(mine, '<b>x</i> </u> <s>')
        UNION ALL SELECT file_name, line_no, 'TAG_TYPE_MISSING', unnest(['b=1', 'i=2']) FROM good WHERE contains(theirs, '<b=1,i=2>') AND NOT contains(mine, '<b=1,i=2>')
        UNION ALL SELECT file_name, NULL, 'LINE_COUNT', count(mine) || ' ' || count(theirs) FROM pairs GROUP BY file_name HAVING count(mine) <> count(theirs)
        UNION ALL SELECT file_name, NULL, CASE WHEN in_left THEN 'ONLY_IN_CHUNKS' ELSE 'ONLY_IN_ORIGIN' END, NULL FROM names WHERE in_left <> in_right
        UNION ALL SELECT NULL, NULL, 'FILE_COUNT', count_if(in_left) || ' ' || count_if(in_right) FROM names HAVING count_if(in_left) <> count_if(in_right))"""


@query(f"WITH {EDITED} SELECT file_name, coalesce(line_no::VARCHAR, '') AS line_no, CASE WHEN rule = 'FILE_COUNT' THEN 'warning' ELSE 'error' END AS severity, rule, detail FROM faults")
def line_diff(spark, sf_dir):
    return checks.verify(*edited_lines(spark, sf_dir)).withColumn("line_no", F.coalesce(F.col("line_no").cast("string"), F.lit("")))


#: One file in ten is edited; of the others some first lines have no id on either side.
_NO_ID = "CASE WHEN doc_id % 30 = 1 AND line_ord = 0 THEN text WHEN"
EDITED_SOME = (EDITED.replace("CASE WHEN spot % 5 = 0 THEN tags ELSE plain END AS line FROM spots", f"{_NO_ID} spot % 5 = 0 THEN tags ELSE plain END AS line FROM spots")
               .replace("CASE WHEN spot % 11 = 3", f"{_NO_ID} doc_id % 10 <> 0 AND spot % 5 = 0 THEN tags WHEN doc_id % 10 <> 0 THEN plain WHEN spot % 11 = 3").replace("(spot % 19 <> 6", "(doc_id % 10 <> 0 OR spot % 19 <> 6"))


@query(f"WITH {EDITED_SOME} SELECT file_name, coalesce(line_no::VARCHAR, '') AS line_no, CASE WHEN rule = 'FILE_COUNT' THEN 'warning' ELSE 'error' END AS severity, rule, detail FROM faults")
def line_diff_changed(spark, sf_dir):
    """Files told apart by digests first; lines of those that differ are paired."""
    return checks.verify_changed(*edited_lines(spark, sf_dir, some=True)).withColumn("line_no", F.coalesce(F.col("line_no").cast("string"), F.lit("")))


@query(f"WITH {EDITED} SELECT count_if(rule <> 'FILE_COUNT')::BIGINT AS n_errors, count_if(rule = 'FILE_COUNT')::BIGINT AS n_warnings, count_if(rule <> 'FILE_COUNT') = 0 AS passed FROM faults")
def violation_report(spark, sf_dir):
    return checks.report(line_diff(spark, sf_dir))


@query("""SELECT doc_id, bool_or(l) AS in_left, bool_or(r) AS in_right FROM (SELECT DISTINCT doc_id, true AS l, false AS r FROM documents UNION ALL SELECT DISTINCT doc_id, false, true FROM labels) GROUP BY doc_id""")
def name_set_diff(spark, sf_dir):
    return checks.compare_names(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query(f"""WITH {LINES} SELECT doc_id, lpad(upper(to_hex(line_ord // 4)), 6, '0') AS para_id, arg_max(text, {{'a': 'chunk_' || (line_ord % 12) || '.md', 'b': line_ord}}) AS text FROM lines GROUP BY ALL""")
def para_map_last_wins(spark, sf_dir):
    """Of lines that share an id, the last by file name (as text: chunk_10 before chunk_2) and number."""
    raw = lines(spark, sf_dir).select("doc_id", "line_ord", F.concat(F.lit("chunk_"), (F.col("line_ord") % 12).cast("string"), F.lit(".md")).alias("file_name"),
                                      text.chunk_line(F.lpad(F.hex((F.col("line_ord") / 4).cast("int")), 6, "0"), F.col("text")).alias("line"))
    parsed = raw.withColumn("p", text.parse_line(F.col("line"))).where("p is not null").select("doc_id", "file_name", "line_ord", "p.*")
    return lookups.last_by(parsed, ["doc_id", "para_id"], "text", ["file_name", "line_ord"])


@query(f"""WITH {RANKED}, cats AS (SELECT conv_id, 'F' || rank AS cat_id, role FROM ranked),
    wanted AS (SELECT conv_id, cat_id FROM cats UNION SELECT conv_id, 'F3' FROM cats),
    own AS (SELECT * FROM cats WHERE conv_id % 4 <> 1 AND NOT (conv_id % 3 = 0 AND cat_id = 'F1')),
    overall AS (SELECT cat_id, min(role) AS role FROM cats GROUP BY cat_id)
    SELECT w.conv_id, w.cat_id, CASE WHEN w.conv_id IN (SELECT conv_id FROM own) THEN o.role ELSE a.role END AS role
    FROM wanted w LEFT JOIN own o ON w.conv_id = o.conv_id AND w.cat_id = o.cat_id LEFT JOIN overall a ON w.cat_id = a.cat_id""")
def registry_lookup(spark, sf_dir):
    cats = category_rank(spark, sf_dir).select("conv_id", "cat_id", "role")
    wanted = cats.select("conv_id", "cat_id").union(cats.select("conv_id", F.lit("F3"))).distinct()
    own = cats.where("conv_id % 4 <> 1 and not (conv_id % 3 = 0 and cat_id = 'F1')")
    return lookups.lookup_formats(wanted, own, cats.groupBy("cat_id").agg(F.min("role").alias("role")), ["conv_id"], "role")


@query("""SELECT d.doc_id, coalesce(o.text, d.text) AS text, o.doc_id IS NOT NULL AS overridden FROM documents d LEFT JOIN (SELECT doc_id, upper(lang) || text AS text FROM documents WHERE doc_id % 5 = 2) o ON d.doc_id = o.doc_id""")
def parts_override(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lookups.override(docs.select("doc_id", "text"), docs.where("doc_id % 5 = 2").select("doc_id", F.concat(F.upper("lang"), F.col("text")).alias("text")), ["doc_id"], "text")


FMT = {
    "font_ascii": "CASE p_partkey % 4 WHEN 0 THEN 'Times New Roman' WHEN 1 THEN 'Arial' ELSE '' END",
    "font_east_asia": "CASE p_partkey % 5 WHEN 0 THEN '宋体' WHEN 1 THEN '黑体' ELSE '' END",
    "size": "CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size + 3 END", "bold": "p_partkey % 3 = 0", "italic": "p_partkey % 7 = 0",
    "highlight": "CASE WHEN p_partkey % 11 = 0 THEN 'yellow' ELSE '' END", "color": "CASE p_partkey % 6 WHEN 0 THEN '000000' WHEN 1 THEN 'FF0000' ELSE '' END",
    "underline": "CASE WHEN p_partkey % 8 = 0 THEN 'single' ELSE '' END", "strike": "p_partkey % 9 = 0", "dstrike": "p_partkey % 10 = 0",
    "vert_align": "CASE p_partkey % 12 WHEN 0 THEN 'superscript' WHEN 1 THEN 'subscript' ELSE '' END", "small_caps": "p_partkey % 13 = 0"}
_FMT_SQL = "fmt AS (SELECT p_partkey, " + ", ".join(f"{v} AS {k}" for k, v in FMT.items()) + " FROM part), f AS (SELECT *, coalesce(nullif(font_east_asia, ''), nullif(font_ascii, ''), '宋体') AS font FROM fmt)"


def _formats(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.struct(*(F.expr(v).cast(formats.FORMAT[k].dataType).alias(k) for k, v in FMT.items())).alias("fmt"))


@query(f"""WITH {_FMT_SQL} SELECT p_partkey, concat_ws('/', replace(replace(font, 'Times New Roman', 'TNR'), '宋体', 'SimSun'),
        CASE size WHEN 0 THEN NULL WHEN 24 THEN '小四' WHEN 28 THEN '四号' WHEN 32 THEN '三号' WHEN 36 THEN '小二' ELSE (size // 2) || 'pt' END,
        CASE WHEN bold THEN '加粗' END, CASE WHEN italic THEN '斜体' END, CASE WHEN underline <> '' THEN '下划线' END, CASE WHEN strike OR dstrike THEN '删除线' END,
        CASE vert_align WHEN 'superscript' THEN '上标' WHEN 'subscript' THEN '下标' END, CASE WHEN small_caps THEN '小型大写' END,
        CASE WHEN highlight <> '' THEN '高亮' || highlight END, CASE WHEN color NOT IN ('', '000000') THEN '色' || color END) AS label FROM f""")
def format_label(spark, sf_dir):
    return _formats(spark, sf_dir).select("p_partkey", formats.label(F.col("fmt")).alias("label"))


@query(f"""WITH {_FMT_SQL} SELECT p_partkey, coalesce(nullif(concat_ws(',', CASE WHEN bold THEN 'b' END, CASE WHEN italic THEN 'i' END, CASE WHEN underline <> '' THEN 'u' END,
        CASE WHEN strike OR dstrike THEN 's' END, nullif(substr(vert_align, 1, 3), ''), CASE WHEN font NOT IN ('宋体', 'SimSun') THEN replace(font, 'Times New Roman', 'TNR') END), ''), 'fmt') AS hint FROM f""")
def format_hint(spark, sf_dir):
    return _formats(spark, sf_dir).select("p_partkey", formats.hint(F.col("fmt")).alias("hint"))


@query(f"""WITH {_FMT_SQL} SELECT font, size::INT AS size, bold, italic, highlight, color, underline, strike OR dstrike AS struck, vert_align, small_caps, count(*) AS n
        FROM f GROUP BY ALL""")
def category_keys(spark, sf_dir):
    keys = _formats(spark, sf_dir).select(formats.category_key(F.col("fmt")).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key.*", "n")


_SYMBOLS = "concat(text, ' 20°C → 3 × 4 · ', 'αx ≤ β²', ' $α→βx × 2$ ', '∏÷ 7 ℝ″')"


# What SQL holds the characters and their commands to be; written out here, not taken from the code that is tested.
_SYMBOL_ROWS = r"""
    ('∈', '\in'), ('∉', '\notin'), ('⊂', '\subset'), ('⊆', '\subseteq'), ('∪', '\cup'), ('∩', '\cap'), ('∅', '\emptyset'), ('∞', '\infty'), ('∑', '\sum'), 
    ('∏', '\Pi'), ('∫', '\int'), ('∂', '\partial'), ('∇', '\nabla'), ('√', '\sqrt'), ('∆', '\Delta'), ('Σ', '\Sigma'), ('Ω', '\Omega'), ('α', '\alpha'), 
    ('β', '\beta'), ('γ', '\gamma'), ('δ', '\delta'), ('ε', '\epsilon'), ('θ', '\theta'), ('λ', '\lambda'), ('μ', '\mu'), ('π', '\pi'), ('ρ', '\rho'), 
    ('σ', '\sigma'), ('τ', '\tau'), ('φ', '\phi'), ('ω', '\omega'), ('→', '\rightarrow'), ('←', '\leftarrow'), ('↔', '\leftrightarrow'), 
    ('⇒', '\Rightarrow'), ('⇐', '\Leftarrow'), ('⇔', '\Leftrightarrow'), ('≤', '\leq'), ('≥', '\geq'), ('≠', '\neq'), ('≈', '\approx'), ('≡', '\equiv'), 
    ('±', '\pm'), ('∓', '\mp'), ('×', '\times '), ('÷', '\div '), ('·', '\cdot '), ('ℝ', '\mathbb{R}'), ('ℕ', '\mathbb{N}'), ('ℤ', '\mathbb{Z}'), 
    ('ℂ', '\mathbb{C}'), ('°', '^\circ'), ('′', ''''), ('″', '\prime\prime')"""


@query(rf"""WITH RECURSIVE symbols AS (SELECT *, row_number() OVER () AS i FROM (VALUES {_SYMBOL_ROWS}) t(char, command)),
    changed AS (SELECT doc_id, {_SYMBOLS} AS text, 0::BIGINT AS i FROM documents
        UNION ALL SELECT doc_id, replace(c.text, s.char, s.command), s.i FROM changed c JOIN symbols s ON s.i = c.i + 1)
    SELECT doc_id, regexp_replace(text, '\\(times|div|cdot)\s+', '\\\1 ', 'g') AS text FROM changed WHERE i = (SELECT max(i) FROM symbols)""")
def math_to_latex(spark, sf_dir):
    """Mathematical characters everywhere as LaTeX, the way that is kept for compatibility."""
    return table(spark, sf_dir, "documents").select("doc_id", text.math_to_latex(F.expr(_SYMBOLS), compat=True).alias("text"))


@query("SELECT doc_id, replace(text, '$', '') || ' a→b $\\alpha x \\rightarrow\\beta$ × 2' AS text FROM documents")
def math_in_formulas(spark, sf_dir):
    """Mathematical characters as LaTeX within formulas only."""
    return table(spark, sf_dir, "documents").select("doc_id", text.math_to_latex(F.expr("concat(replace(text, '$', ''), ' a→b $αx →β$ × 2')")).alias("text"))


@query("""SELECT doc_id, i::INT AS pos, found[i] AS formula FROM (SELECT doc_id, regexp_extract_all(text || ' $a_1$ and $$b$$', '(?s)\\$\\$[^$].*?\\$\\$|\\$[^$]+\\$') AS found FROM documents), range(1, 10000) t(i) WHERE i <= len(found)""")
def formula_split(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").select("doc_id", F.filter(text.split_formulas(F.concat("text", F.lit(" $a_1$ and $$b$$"))), lambda p: p["is_formula"]).alias("p"))
    return parts.select("doc_id", F.posexplode("p").alias("pos", "p")).select("doc_id", (F.col("pos") + 1).alias("pos"), F.col("p.text").alias("formula"))


_MAYBE = "CASE doc_id % 5 WHEN 0 THEN concat('$', doc_id, '$') WHEN 1 THEN concat('  $$x+', doc_id, '$$ (', doc_id, ') ') WHEN 2 THEN concat('a $', doc_id, '$') WHEN 3 THEN '$x$ and $y$' ELSE concat('$x$  (', lang, ')') END"


@query(f"""WITH m AS (SELECT doc_id, {_MAYBE} AS t FROM documents), n AS (SELECT doc_id, t, trim(t) AS s, '^(\\$\\$[^$].*?\\$\\$|\\$[^$]+\\$)(\\s*\\([^)]*\\))?$' AS p FROM m)
    SELECT doc_id, regexp_matches(s, p) AS is_formula, CASE WHEN regexp_matches(s, p) THEN regexp_extract(s, p, 1) ELSE t END AS formula, CASE WHEN regexp_matches(s, p) THEN nullif(trim(regexp_extract(s, p, 2)), '') END AS tag FROM n""")
def formula_only(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(text.formula_only(F.expr(_MAYBE)))))


@query("SELECT doc_id, 'x=' || doc_id AS formula, CASE WHEN doc_id % 2 = 1 THEN '(' || lang || ')' END AS tag FROM documents")
def equation_tag(spark, sf_dir):
    formula = F.expr("CASE WHEN doc_id % 2 = 1 THEN concat('x=', doc_id, '  \\\\tag{', lang, '} y') ELSE concat('x=', doc_id) END")
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(text.equation_tag(formula))))


@query(f"""WITH {TAGGED}, parts AS (SELECT conv_id, island, rank, text FROM merged), 
    joined AS (SELECT conv_id, island, rank, text, CASE WHEN lag(rank) OVER (PARTITION BY conv_id ORDER BY island) = 0 AND rank = 0 THEN 0 ELSE 1 END AS new FROM parts)
    SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY island) - 1)::INT AS seg_ord, text, CASE WHEN rank > 0 THEN 'F' || rank END AS cat_id FROM joined""")
def segment_tokens(spark, sf_dir):
    found = tagged_text(spark, sf_dir).select("conv_id", F.posexplode(text.segments(F.col("text"))).alias("seg_ord", "s"))
    return found.select("conv_id", "seg_ord", "s.text", "s.cat_id")


@query("SELECT doc_id, 'a' || chr(9) || 'b' || text || 'c' AS text FROM documents")
def xml_illegal_strip(spark, sf_dir):
    dirty = F.concat(F.lit("a\x01\t\x0bb"), F.col("text"), F.lit("\x1f\x7fc"))
    return table(spark, sf_dir, "documents").select("doc_id", text.xml_legal(dirty).alias("text"))


@query("SELECT doc_id, sha256(text) AS doc_hash FROM documents")
def doc_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("doc_hash"))


_ID_LINE = "CASE doc_id % 6 WHEN 0 THEN concat('[0a1b2c3d] ', lang) WHEN 1 THEN concat('[0A1B2C] ', lang) WHEN 2 THEN concat('  [AB]   lead', doc_id) WHEN 3 THEN concat('[0a1b2c3d]', lang) WHEN 4 THEN 'no id' ELSE '[12345678]' || chr(10) END"


@query(f"""WITH l AS (SELECT doc_id, {_ID_LINE} AS line FROM documents), m AS (SELECT *, regexp_replace(line, '^\\s+', '') AS bare FROM l)
    SELECT doc_id, upper(nullif(regexp_extract(line, '^\\[([0-9A-Fa-f]{{8}})\\]', 1), '')) AS strict_id, CASE WHEN regexp_matches(bare, '(?s)^\\[([A-Fa-f0-9]+)\\]\\s+(.*)$') THEN upper(regexp_extract(bare, '(?s)^\\[([A-Fa-f0-9]+)\\]\\s+(.*)$', 1)) END AS lenient_id,
    CASE WHEN regexp_matches(bare, '(?s)^\\[([A-Fa-f0-9]+)\\]\\s+(.*)$') THEN regexp_extract(bare, '(?s)^\\[([A-Fa-f0-9]+)\\]\\s+(.*)$', 2) END AS text FROM m""")
def para_ids(spark, sf_dir):
    line = F.expr(_ID_LINE)
    return table(spark, sf_dir, "documents").select("doc_id", text.strict_para_id(line).alias("strict_id"), text.parse_line(line)["para_id"].alias("lenient_id"), text.parse_line(line)["text"].alias("text"))


@query(f"WITH {RANKED} SELECT conv_id::VARCHAR AS doc_hash, upper(conv_id::VARCHAR) AS para_id, 'F0' AS baseline, 'F' || rank AS cat_id, role AS label, cnt FROM ranked")
def registry_json(spark, sf_dir):
    """Registries written as JSON, one for each conversation, and read again."""
    cats = category_rank(spark, sf_dir).withColumn("label", F.col("role")).withColumn("rpr_xml", F.lit("<w:rPr/>")).withColumn("para", F.col("conv_id"))
    written = lookups.registry_json(cats, "conv_id", "para")
    return lookups.registry_rows(F.col("registry"), written.withColumn("doc_hash", F.col("conv_id").cast("string")), ["doc_hash"]).drop("rpr_xml")


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n_lines, count_if(regexp_replace(text, '\\s', '', 'g') <> '')::BIGINT AS n_kept FROM lines GROUP BY doc_id")
def blank_filter(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(~text.is_blank(F.col("text"))).alias("n_kept"))


# Documents as packages, one made for each conversation. SQL tells what must come out of them; formulas and parts have tests.


def _named(found: DataFrame, packages: DataFrame) -> DataFrame:
    """Rows with the conversation that their package was made for."""
    return found.join(packages.select("doc_hash", "conv_id"), "doc_hash").drop("doc_hash")


_TURNS = """turns AS (SELECT conv_id, turn, lpad(upper(to_hex(turn)), 8, '0') AS para_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS para_ord, role || ' ' AS who,
    replace(coalesce(text, ''), chr(10), ' ') || ' end' AS said, length(coalesce(text, '')) AS v FROM conversations)"""


@query(f"""WITH {_TURNS} SELECT conv_id, para_ord, para_id, unnest([0, 1, 2, 3])::INT AS run_ord, unnest([true, false, false, false]) AS bold, unnest([false, turn % 2 = 1, false, false]) AS italic,
    unnest([0, 0, 24, 24])::INT AS size, unnest([who, said, ' x', 'y']) AS text FROM turns""")
def docx_shred(spark, sf_dir):
    """Runs of each package. Each turn's text is whole."""
    packages = samples.conversation_packages(spark, sf_dir)
    runs = docx.runs(packages).select("doc_hash", "para_ord", "para_id", "run_ord", F.col("fmt.bold").alias("bold"), F.col("fmt.italic").alias("italic"), F.col("fmt.size").alias("size"), "text")
    return _named(runs, packages)


@query(f"""WITH {_TURNS} SELECT conv_id, para_ord, para_id, unnest([0, 1, 2, 3])::INT AS run_ord, unnest([true, false, false, false]) AS bold, unnest([false, turn % 2 = 1, false, false]) AS italic,
    unnest([0, 0, 24, 24])::INT AS size, unnest([who, said, ' x', 'y']) AS text FROM turns""")
def docx_shred_sql(spark, sf_dir):
    """The same rows by a table function, from SQL alone."""
    docx.register_runs(spark)
    return spark.sql("SELECT conv_id, para_ord, para_id, run_ord, fmt.bold, fmt.italic, fmt.size, text FROM {packages}, LATERAL docx_runs(content)", packages=samples.conversation_packages(spark, sf_dir))


@query(f"""WITH {_TURNS}, lines AS (SELECT conv_id, '‹F1:b›' || who || '‹/›‹F2:' || CASE WHEN turn % 2 = 1 THEN 'i' ELSE 'fmt' END || '›' || said || '‹/› xy' AS text FROM turns)
    SELECT 'runs' AS step, unnest(['rows', 'characters']) AS counter, unnest([4 * count(*), sum(length(who) + length(said) + 3)])::BIGINT AS value FROM turns
    UNION ALL SELECT 'paragraphs', unnest(['rows', 'characters']), unnest([count(*), sum(length(text))])::BIGINT FROM lines""")
def progress_counters(spark, sf_dir):
    """What passed through an extraction, counted on the way."""
    counters = Counters(spark)
    runs = counters.count(docx.runs(samples.conversation_packages(spark, sf_dir)), "runs", characters=F.length("text"))
    runs = Scratch(spark, "counted").save(runs, "runs")
    lines = counters.count(documents.extract(runs)[0], "paragraphs", characters=F.length("text"))
    lines.write.format("noop").mode("overwrite").save()
    return counters.table()


@query(f"""WITH {_TURNS} SELECT conv_id, para_ord, para_id, unnest([0, 1, 2, 3])::INT AS run_ord, unnest([true, false, false, false]) AS bold, unnest([who, said, ' x', 'y']) AS text FROM turns""")
def docx_members(spark, sf_dir):
    """Runs of packages with a picture in storage: the filter on the name goes down to the source, and the picture is not read."""
    packages = samples.conversation_packages(spark, sf_dir, picture=8192)
    place = Scratch(spark, "docx-members").path("files")
    root = place if "://" in place else f"file://{place}"
    chunks.write_files(packages.select(F.col("path").alias("file_name"), "content"), root)
    runs = docx.part_runs(members.read_members(spark, root).where("arcname = 'word/document.xml'"))
    return runs.select(F.regexp_extract("path", "([0-9]+)[.]docx$", 1).cast("long").alias("conv_id"), "para_ord", "para_id", "run_ord", F.col("fmt.bold").alias("bold"), "text")


@query("SELECT DISTINCT conv_id, unnest([0, 1])::INT AS part_ord, unnest(['[Content_Types].xml', 'word/document.xml']) AS arcname FROM conversations")
def docx_parts(spark, sf_dir):
    packages = samples.conversation_packages(spark, sf_dir)
    return _named(docx.parts(packages).select("doc_hash", "part_ord", "arcname"), packages)


@query(f"""WITH {_TURNS} SELECT conv_id, para_ord, para_id, '‹F1:b›' || who || '‹/›‹F2:' || CASE WHEN turn % 2 = 1 THEN 'i' ELSE 'fmt' END || '›' || said || '‹/› xy' AS text FROM turns""")
def docx_extract(spark, sf_dir):
    """Chunk lines of the tagged paragraphs of each package."""
    packages = samples.conversation_packages(spark, sf_dir)
    chunks, _ = documents.extract(documents.shred(packages))
    return _named(chunks.select("doc_hash", "para_ord", "para_id", "text"), packages)


#: Folders that files are dealt over, so that none has very many.
FOLDERS = 1024


def _root(place: str) -> str:
    return place if "://" in place else f"file://{place}"


@query(f"""WITH RECURSIVE {_TURNS}, lines AS (SELECT *, '‹F1:b›' || who || '‹/›‹F2:' || CASE WHEN turn % 2 = 1 THEN 'i' ELSE 'fmt' END || '›' || said || '‹/› xy' AS text FROM turns),
    items AS (SELECT *, length(text) AS n FROM lines),
    packed AS (
        SELECT conv_id, para_ord, 0 AS chunk, CASE WHEN n > 1000 THEN 1 ELSE 0 END AS idx, CASE WHEN n > 1000 THEN 0 ELSE n END AS held, n <= 1000 AS open FROM items WHERE para_ord = 0
        UNION ALL
        SELECT i.conv_id, i.para_ord, CASE WHEN p.open AND p.held + i.n > 1000 THEN p.idx + 1 ELSE p.idx END,
               CASE WHEN i.n > 1000 THEN p.idx + CASE WHEN p.open THEN 2 ELSE 1 END WHEN p.open AND p.held + i.n > 1000 THEN p.idx + 1 ELSE p.idx END,
               CASE WHEN i.n > 1000 THEN 0 WHEN p.open AND p.held + i.n > 1000 THEN i.n ELSE p.held + i.n END, i.n <= 1000
        FROM packed p JOIN items i ON i.conv_id = p.conv_id AND i.para_ord = p.para_ord + 1)
    SELECT conv_id, 'chunk_' || chunk || '.md' AS file_name, string_agg('[' || para_id || '] ' || text, chr(10) ORDER BY para_ord) AS content FROM packed JOIN items USING (conv_id, para_ord) GROUP BY conv_id, chunk""")
def chunk_files(spark, sf_dir):
    """The chunk files of each package, written and read again."""
    packages = samples.conversation_packages(spark, sf_dir)
    lines, _ = documents.extract(documents.shred(packages))
    files = _named(chunks.chunk_files(lines, "doc_hash"), packages).withColumn("name", F.concat(F.lit("chunk_of_"), F.col("conv_id").cast("string"), F.lit("-"), F.col("file_name")))
    root = _root(Scratch(spark, "chunk-files").path("files"))
    chunks.write_files(files.select(F.col("name").alias("file_name"), "content", (F.col("conv_id") % FOLDERS).alias("folder")), root, "folder")
    read = chunks.lines_of(chunks.as_text(chunks.read_tree(spark, root)))
    line = F.struct("line_no", "line")
    whole = read.groupBy("file_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("content"))
    return whole.select(F.regexp_extract("file_name", "chunk_of_([0-9]+)-", 1).cast("long").alias("conv_id"), F.regexp_extract("file_name", "-(.*)$", 1).alias("file_name"), "content")


@query("""SELECT conv_id, 'chunk_' || i || '.md' AS file_name, 'again ' || i || ' ' || text AS content FROM (SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS text, count(*) AS n FROM conversations GROUP BY conv_id), range(0, 3) t(i)
    WHERE i <= n % 3 UNION ALL SELECT conv_id, 'notes.md', 'kept' FROM (SELECT DISTINCT conv_id FROM conversations)""")
def chunk_rewrite(spark, sf_dir):
    """Three chunk files for each conversation, and a file beside them; then fewer chunks: those of the first run are gone."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), " ").alias("text"), F.count(F.lit(1)).alias("n"))
    rows = turns.select("conv_id", "text", "n", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    named = rows.select(F.concat(F.lit("of-"), F.col("conv_id").cast("string")).alias("folder"), F.concat(F.lit("chunk_"), F.col("i").cast("string"), F.lit(".md")).alias("file_name"), "text", "n", "i")
    scratch = Scratch(spark, "chunk-rewrite")
    root = _root(scratch.path("files"))
    notes = named.where("i = 0").select("folder", F.lit("notes.md").alias("file_name"), F.lit("kept").alias("content"))
    chunks.write_files(named.select("folder", "file_name", F.concat(F.lit("first "), F.col("text")).alias("content")).unionByName(notes), root, "folder", replaces="chunk_*.md")
    again = F.concat(F.lit("again "), F.col("i").cast("string"), F.lit(" "), F.col("text"))
    chunks.write_files(named.where("i <= n % 3").select("folder", "file_name", again.alias("content")), root, "folder", replaces="chunk_*.md")
    read = chunks.read_tree(spark, root)
    return read.select(F.regexp_extract("path", "of-([0-9]+)/[^/]*$", 1).cast("long").alias("conv_id"), F.regexp_extract("path", "([^/]*)$", 1).alias("file_name"), F.col("content").cast("string").alias("content"))


@query("SELECT 'chunk_' || doc_id || '.md' AS file_name, 'READ_FAILED' AS rule, 'error' AS severity FROM documents WHERE doc_id % 7 = 3 UNION ALL SELECT NULL, 'DIR_MISSING', 'error'")
def read_faults(spark, sf_dir):
    """Files that are no text, among others that are read; and a folder that is not there."""
    content = F.col("text").cast("binary")
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("chunk_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"), F.when(F.col("doc_id") % 7 == 3, F.concat(content, F.unhex(F.lit("FF")))).otherwise(content).alias("content"), (F.col("doc_id") % FOLDERS).alias("folder"))
    place = Scratch(spark, "read-faults").path("files")
    chunks.write_files(files, _root(place), "folder")
    folders = spark.createDataFrame([(x, is_there(spark, x)) for x in (place, place + "-none")], "folder string, there boolean")
    return checks.read_faults(chunks.unread(chunks.as_text(chunks.read_tree(spark, _root(place), "chunk_*.md")))).unionByName(checks.missing_folders(folders)).select("file_name", "rule", "severity")


def _chunked(lines: DataFrame) -> DataFrame:
    """Lines as if read from their chunk files."""
    return lines.select("doc_hash", "para_id", "text", F.concat(F.lit("chunk_"), F.col("chunk_idx").cast("string"), F.lit(".md")).alias("file_name"), "line_no")


@query(f"WITH {_TURNS} SELECT conv_id, para_id, unnest([0, 1, 2])::INT AS run_ord, unnest([true, false, false]) AS bold, unnest([who, said, ' xy']) AS text FROM turns")
def docx_rebuild(spark, sf_dir):
    """Packages rebuilt from their own chunks and registries: the runs of the result."""
    packages = samples.conversation_packages(spark, sf_dir)
    lines, registries = documents.extract(documents.shred(packages))
    rebuilt = documents.rebuild(packages, _chunked(lines), registries, order=["file_name", "line_no"])
    again = _named(documents.shred(rebuilt), packages)  # runs of the new packages, under the old ones' hashes
    return again.select("conv_id", "para_id", "run_ord", F.col("fmt.bold").alias("bold"), "text")


@query("""SELECT conv_id, 'F' || unnest([0, 1, 2, 3][:CASE WHEN odd > 0 AND even > 0 THEN 4 ELSE 3 END]) AS cat_id,
        unnest(list_reverse_sort([2 * n, n, odd, even])[:CASE WHEN odd > 0 AND even > 0 THEN 4 ELSE 3 END])::BIGINT AS cnt
    FROM (SELECT conv_id, count(*) AS n, count_if(turn % 2 = 1) AS odd, count_if(turn % 2 = 0) AS even FROM conversations GROUP BY conv_id)""")
def docx_profile(spark, sf_dir):
    """Categories of each whole package: their ranks and counts."""
    packages = samples.conversation_packages(spark, sf_dir)
    return _named(documents.profile(docx.runs(packages)).select("doc_hash", "cat_id", "cnt"), packages)


# Packages with formulas beside, in and without runs, objects, tabs, bookmarks, links and pictures.

_ODD_RUNS = r"""odd AS (SELECT conv_id, para_ord, turn, v, unnest(CASE turn % 6
        WHEN 0 THEN [{'text': 'x' || v || '=', 'formulas': '', 'own': false}, {'text': '', 'formulas': '$\frac{' || v || '}{2}$', 'own': true}]
        WHEN 1 THEN [{'text': 'A', 'formulas': '', 'own': false}, {'text': '', 'formulas': '$y' || v || '$', 'own': false}, {'text': 'B', 'formulas': '', 'own': false}]
        WHEN 2 THEN [{'text': 'o $z' || v || '$ p', 'formulas': '', 'own': false}]
        WHEN 3 THEN [{'text': '', 'formulas': '$w' || v || '$', 'own': true}]
        WHEN 4 THEN [{'text': 't' || v, 'formulas': '', 'own': false}]
        ELSE [{'text': 'bold', 'formulas': '', 'own': false}, {'text': ' plain ' || v, 'formulas': '', 'own': false}] END) AS r FROM turns)"""


@query(f"WITH {_TURNS}, {_ODD_RUNS} SELECT conv_id, para_ord, r.text AS text, r.formulas AS formulas, r.own AS formula_run FROM odd")
def docx_odd_runs(spark, sf_dir):
    """Runs: texts with formulas of objects, formulas of their own; runs and formulas that hold nothing are left out."""
    packages = samples.odd_packages(spark, sf_dir)
    return _named(docx.runs(packages).select("doc_hash", "para_ord", "text", F.array_join("formulas", "|").alias("formulas"), F.col("fmt").isNull().alias("formula_run")), packages)


@query(f"""WITH {_TURNS} SELECT conv_id, para_ord, 'Arial' AS font_ascii, '黑体' AS font_east_asia, 28 AS size, true AS bold, false AS italic, 'yellow' AS highlight, 'FF0000' AS color, 'double' AS underline,
    true AS strike, false AS dstrike, 'subscript' AS vert_align, true AS small_caps FROM turns WHERE turn % 6 = 5""")
def docx_formats(spark, sf_dir):
    """All properties of a run's format."""
    packages = samples.odd_packages(spark, sf_dir)
    return _named(docx.runs(packages).where("text = 'bold'").select("doc_hash", "para_ord", "fmt.*"), packages)


@query(rf"""WITH {_TURNS} SELECT conv_id, para_ord, CASE turn % 6 WHEN 0 THEN 'x' || v || '=$\frac{{' || v || '}}{{2}}$' WHEN 1 THEN 'A$y' || v || '$B' WHEN 2 THEN 'o $z' || v || '$ p' WHEN 4 THEN 't' || v
        ELSE 'bold‹F1:fmt› plain ' || v || '‹/›' END AS text FROM turns WHERE turn % 6 <> 3""")
def docx_odd_extract(spark, sf_dir):
    """Tagged paragraphs; those of formulas only are left out, and formulas end the islands."""
    packages = samples.odd_packages(spark, sf_dir)
    lines, _ = documents.extract(documents.shred(packages))
    return _named(lines.select("doc_hash", "para_ord", "text"), packages)


@query(f"""WITH {_TURNS} SELECT conv_id, para_ord, CASE turn % 6 WHEN 0 THEN 'r(t) oMath r(t) r(t)' WHEN 1 THEN 'r(t) r(oMath) r(oMath) r(rPr) r(t)' WHEN 2 THEN 'r(t) oMath r(t)' WHEN 3 THEN 'oMath'
        WHEN 4 THEN 'r(tab) oMath r(tab) r(t)' ELSE 'bookmarkStart r(rPr,t) r(t) r(rPr,t) hyperlink r(drawing) bookmarkEnd' END AS outline FROM turns""")
def docx_odd_rebuild(spark, sf_dir):
    """What is in each paragraph after edits with formulas, tags, a numbered equation between tabs; what was no text stays."""
    packages = samples.odd_packages(spark, sf_dir)
    lines, registries = documents.extract(documents.shred(packages))
    kind = F.conv("para_id", 16, 10).cast("long") % 6
    edited = (F.when(kind == 0, F.concat("text", F.lit(" and "), F.lit("‹F0:fmt›more‹/›"))).when(kind == 4, F.concat(F.lit("$$y="), "text", F.lit(r" \tag{3}$$"))).when(kind == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    rebuilt = documents.rebuild(packages, lines.where(kind != 1).select("doc_hash", "para_id", edited.alias("text")), registries)
    return _named(docx.outlines(rebuilt), packages)


@query(f"""WITH {_TURNS}, edits AS (SELECT conv_id, para_id, para_ord, said, unnest([0, 1, 2]) AS i, unnest(['chunk_9.md', 'chunk_10.md', 'chunk_9.md']) AS file_name, unnest([1, 7, CASE WHEN para_ord % 2 = 1 THEN 5 ELSE 0 END]) AS line_no FROM turns),
    last AS (SELECT conv_id, para_ord // 3 AS third, arg_max('e' || i || ' ' || said, {{'a': file_name, 'b': line_no, 'c': para_ord}}) AS text FROM edits GROUP BY ALL)
    SELECT conv_id, para_ord, text FROM turns JOIN last USING (conv_id) WHERE third = para_ord // 3""")
def docx_repeated_ids(spark, sf_dir):
    """Packages in which each three paragraphs share an id, edited several times: the last edit by file name and line goes to all that have the id."""
    packages = samples.conversation_packages(spark, sf_dir, each=3)
    said = docx.runs(packages).where("run_ord = 1").select("doc_hash", "para_ord", "para_id", "text")
    edits = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(f"chunk_{n}.md").alias("file_name"), line.alias("line_no")) for i, n, line in (
        (0, 9, F.lit(1)), (1, 10, F.lit(7)), (2, 9, F.when(F.col("para_ord") % 2 == 1, 5).otherwise(0)))))
    texts = said.select("doc_hash", "para_id", "para_ord", "text", F.inline(edits)).withColumn("text", F.concat(F.lit("e"), F.col("i").cast("string"), F.lit(" "), F.col("text")))
    none = spark.createDataFrame([], "doc_hash string, registry string")
    rebuilt = documents.rebuild(packages, texts, none, order=["file_name", "line_no", "para_ord"])
    return _named(docx.runs(rebuilt).groupBy("doc_hash", "para_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_ord", "text"))), lambda x: x["text"]), "").alias("text")), packages)


_FAULTS = "faults AS (SELECT 'chunk_' || doc_id || '.md' AS file_name, 'error' AS severity FROM labels WHERE quality = 0)"


@query(f"""WITH {_FAULTS}, earlier AS (SELECT 'chunk_' || doc_id || '.md' AS file_name, (doc_id % 4)::INT AS attempt FROM labels)
    SELECT f.file_name, coalesce(attempt, 0) + 1 AS attempt, coalesce(attempt, 0) + 1 >= 3 AS for_a_human FROM (SELECT DISTINCT file_name FROM faults) f LEFT JOIN (SELECT file_name, max(attempt) AS attempt FROM earlier GROUP BY 1) e ON f.file_name = e.file_name""")
def fault_attempts(spark, sf_dir):
    """How often each file with faults has been tried, and which are for a human to see to."""
    labels = table(spark, sf_dir, "labels").withColumn("file_name", F.concat(F.lit("chunk_"), F.col("doc_id").cast("string"), F.lit(".md")))
    faults = labels.where("quality = 0").select("file_name", F.lit("error").alias("severity"))
    return checks.attempts(faults, labels.select("file_name", (F.col("doc_id") % 4).cast("int").alias("attempt")))


@query("""WITH checked AS (SELECT 'chunk_' || doc_id || '.md' AS file_name, v AS version, doc_id % (v + 1) = 0 OR doc_id % 7 = 0 AS wrong FROM documents, range(1, 5) t(v)),
    runs AS (SELECT file_name, max(version) AS last, coalesce(max(version) FILTER (WHERE NOT wrong), 0) AS passed FROM checked GROUP BY file_name)
    SELECT file_name, (last - passed)::INT AS attempt, last - passed >= 3 AS for_a_human FROM runs WHERE last > passed""")
def attempts_stream(spark, sf_dir):
    """Four versions of each file checked one after another, a stream started for each on the same state: how often each file was wrong in a row."""
    docs, scratch = table(spark, sf_dir, "documents").select("doc_id"), Scratch(spark, "attempts")
    for version in range(1, 5):
        wrong = F.expr(f"CAST(doc_id % {version + 1} = 0 OR doc_id % 7 = 0 AS BIGINT)")
        rows = docs.select(F.concat(F.lit("chunk_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"), F.lit(version).cast("long").alias("version"), wrong.alias("n_errors"))
        rows.write.mode("append").parquet(scratch.path("checked"))
        attempts.follow(spark, scratch.path("checked"), scratch.path("tried"), scratch.path("log")).awaitTermination()
    return attempts.standing(spark.read.schema(attempts.TRIED).parquet(scratch.path("tried")))


_FORMULAS = r"""CASE doc_id % 11 WHEN 0 THEN concat('x_', doc_id % 10, '^2 + \\frac{', doc_id, '}{\\sqrt[3]{y}} \\leq \\alpha_{', lang, '}') WHEN 1 THEN concat('\\sin(x+', doc_id, ')') WHEN 2 THEN concat('(a+', doc_id, ')^{2}')
    WHEN 3 THEN concat('\\begin{bmatrix}1 & 2\\\\3 & ', doc_id, '\\end{bmatrix}') WHEN 4 THEN concat('\\begin{cases}', doc_id, ' & a\\\\b\\end{cases}') WHEN 5 THEN concat('\\vec{v}+\\text{if }', doc_id)
    WHEN 6 THEN concat('\\sqrt{', doc_id, '}\\quad \\beta') WHEN 7 THEN concat('‖_{', doc_id, '}') WHEN 8 THEN concat('\\times ', doc_id, ' \\cdot\\max') WHEN 9 THEN concat('ab_{', doc_id, '}') ELSE concat('x^{', doc_id, '}_{2}') END"""
#: The elements without their prefix; ⟦ ⟧: a run, ⟪ ⟧: one of a Greek letter, ¤: control properties.
_ELEMENTS = """CASE doc_id % 11
    WHEN 0 THEN '<sSubSup><sSubSupPr>¤</sSubSupPr><e>⟦x⟧¤</e><sub>⟦' || doc_id % 10 || '⟧¤</sub><sup>⟦2⟧¤</sup>¤</sSubSup>⟦+⟧<f><fPr>¤</fPr><num>⟦' || doc_id || '⟧¤</num><den><rad><radPr>¤</radPr><deg>⟦3⟧¤</deg><e>⟦y⟧¤</e></rad>¤</den></f>¤⟦≤⟧<sSub><sSubPr>¤</sSubPr><e>⟪α⟧¤</e><sub>⟦' || lang || '⟧¤</sub>¤</sSub>'
    WHEN 1 THEN '⟦sin⟧<d><dPr><begChr val="(" /><endChr val=")" />¤</dPr><e>⟦x⟧⟦+⟧⟦' || doc_id || '⟧¤</e>¤</d>'
    WHEN 2 THEN '<sSup><sSupPr>¤</sSupPr><e>⟦(⟧⟦a⟧⟦+⟧⟦' || doc_id || '⟧⟦)⟧¤</e><sup>⟦2⟧¤</sup>¤</sSup>'
    WHEN 3 THEN '<d><dPr><begChr val="[" /><endChr val="]" />¤</dPr><e><m><mPr><mcs><mc><mcPr><count val="2" /><mcJc val="center" /></mcPr></mc></mcs><plcHide val="1" />¤</mPr><mr><e>⟦1⟧¤</e><e>⟦2⟧¤</e></mr><mr><e>⟦3⟧¤</e><e>⟦' || doc_id || '⟧¤</e></mr></m>¤</e>¤</d>'
    WHEN 4 THEN '<d><dPr><begChr val="{" /><endChr val="" />¤</dPr><e>⟦' || doc_id || '⟧⟦ ⟧⟦b⟧¤</e>¤</d>'
    WHEN 5 THEN '<acc><accPr><chr val="' || chr(8407) || '" />¤</accPr><e>⟦v⟧¤</e></acc>⟦+⟧⟦if ⟧⟦' || doc_id || '⟧'
    WHEN 6 THEN '<rad><radPr><degHide val="1" />¤</radPr><deg>¤</deg><e>⟦' || doc_id || '⟧¤</e></rad>⟦' || chr(8195) || '⟧⟪β⟧'
    WHEN 7 THEN '<sSub><sSubPr>¤</sSubPr><e>⟦‖⟧¤</e><sub>⟦' || doc_id || '⟧¤</sub>¤</sSub>'
    WHEN 8 THEN '⟦×⟧⟦' || doc_id || '⟧⟦⋅⟧⟦max⟧'
    WHEN 9 THEN '⟦a⟧<sSub><sSubPr>¤</sSubPr><e>⟦b⟧¤</e><sub>⟦' || doc_id || '⟧¤</sub>¤</sSub>'
    ELSE '<sSub><sSubPr>¤</sSubPr><e><sSup><sSupPr>¤</sSupPr><e>⟦x⟧¤</e><sup>⟦' || doc_id || '⟧¤</sup>¤</sSup>¤</e><sub>⟦2⟧¤</sub>¤</sSub>' END"""


@query(rf"""WITH short AS (SELECT doc_id, regexp_replace(regexp_replace('<oMath>' || {_ELEMENTS} || '</oMath>', '<(/?)([a-zA-Z])', '<\1m:\2', 'g'), ' val=', ' m:val=', 'g') AS x FROM documents),
    parts AS (SELECT '<w:rPr><w:rFonts w:hint="' AS f, '" w:ascii="Cambria Math" w:hAnsi="Cambria Math" /></w:rPr>' AS g, '<m:r><m:rPr><m:sty m:val="p" /></m:rPr>' AS r)
    SELECT doc_id, replace(replace(replace(replace(replace(x, '⟦', r || f || 'default' || g || '<m:t>'), '⟪', r || f || 'eastAsia' || g || '<m:t>'), '⟧', '</m:t></m:r>'), '¤', '<m:ctrlPr>' || f || 'eastAsia' || g || '</m:ctrlPr>'),
        '<m:oMath>', '<m:oMath xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">') AS omml FROM short, parts""")
def latex_omml(spark, sf_dir):
    """Formulas as Office MathML."""
    return table(spark, sf_dir, "documents").select("doc_id", omml.latex_to_omml()(F.expr(_FORMULAS)).alias("omml"))


@query(r"""SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN 'x_{' || doc_id % 10 || '}^{2}+\frac{' || doc_id || '}{\sqrt[3]{y}}≤α_{' || lang || '}' WHEN 1 THEN 'sinx+' || doc_id WHEN 2 THEN '(a+' || doc_id || ')^{2}'
    WHEN 3 THEN '123' || doc_id WHEN 4 THEN doc_id || ' b' WHEN 5 THEN 'v+if ' || doc_id WHEN 6 THEN '\sqrt{' || doc_id || '}' || chr(8195) || 'β' WHEN 7 THEN '‖_{' || doc_id || '}' WHEN 8 THEN '×' || doc_id || '⋅max'
    WHEN 9 THEN 'ab_{' || doc_id || '}' ELSE 'x^{' || doc_id || '}_{2}' END AS latex FROM documents""")
def omml_latex(spark, sf_dir):
    """Formulas as Office MathML and back."""
    return latex_omml(spark, sf_dir).select("doc_id", omml.omml_to_latex("omml").alias("latex"))
