"""Worked examples of documents: categories, tags, formulas, and the way back."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import wordml
from pagewright.functions.wordml import read_runs, unzip
from pagewright.operators.chunking import pack_chunks
from pagewright.plans import documents, samples
from pagewright.sources import chunks as chunk_files
from pagewright.sources import docx

FONT = '<w:rFonts w:eastAsia="宋体"/>'


def packages(spark, *bodies):
    rows = [(f"{i}.docx", len(x), bytearray(x)) for i, x in enumerate(samples.package(b) for b in bodies)]
    return docx.as_packages(spark.createDataFrame(rows, "path string, length long, content binary"))


def para(*runs, number=1):
    return samples.paragraph_xml(number, list(runs))


def math(inner):
    return f"<m:oMath>{inner}</m:oMath>"


def mt(text):
    return f"<m:r><m:t>{text}</m:t></m:r>"


def shown(spark, body, compat=False):
    runs = docx.runs(packages(spark, body), compat=compat)
    cats = documents.categories(runs)
    return cats.orderBy("cat_id").collect(), [r["text"] for r in documents.tagged_paragraphs(runs, compat=compat).collect()]


def test_categories_and_tags(spark):
    size = FONT + '<w:sz w:val="24"/>'
    cats, text = shown(spark, para((size, "Hello "), (size + "<w:b/>", "world"), (size, "!")))
    assert [(c["cat_id"], c["cnt"], c["label"], c["is_baseline"]) for c in cats] == [("F0", 2, "SimSun/小四", True), ("F1", 1, "SimSun/小四/加粗", False)]
    assert text == ["Hello ‹F1:b›world‹/›!"]


def test_ties_go_to_the_first_seen_and_missing_properties_stay_null(spark):
    cats, text = shown(spark, para(("<w:i/>", "a"), ("", "b")))
    assert [c["rpr_xml"] is None for c in cats] == [False, True]
    assert text == ["a‹F1:fmt›b‹/›"]


def test_label_and_hint(spark):
    props = '<w:rFonts w:ascii="Times New Roman"/><w:sz w:val="21"/><w:vertAlign w:val="superscript"/>'
    cats, _ = shown(spark, para((props, "x")))
    assert (cats[0]["label"], cats[0]["hint"]) == ("TNR/10pt/上标", "sup,TNR")


def test_paragraphs_of_formulas_only_and_blank_ones_are_left_out(spark):
    assert shown(spark, f'<w:p>{math(mt("x"))}</w:p>') == ([], [])
    assert shown(spark, para(("", "  ")))[1] == []
    assert shown(spark, para(("", " "), ("<w:b/>", " ")))[1] == [" ‹F1:b› ‹/›"]


def test_formula_after_text(spark):
    half = math(f"<m:f><m:num>{mt('1')}</m:num><m:den>{mt('2')}</m:den></m:f>")
    body = para(("", "x=")).replace("</w:p>", half + "</w:p>")
    assert shown(spark, body)[1] == [r"x=$\frac{1}{2}$"]


def test_formula_in_a_run_without_text(spark):
    body = '<w:p><w:r><w:t>A</w:t></w:r><w:r>' + math(mt("y")) + "</w:r><w:r><w:t>B</w:t></w:r></w:p>"
    assert shown(spark, body)[1] == ["A$y$B"]
    assert shown(spark, body, compat=True)[1] == ["$y$AB"]


def test_switches_and_underline():
    def read(props, compat):
        run = read_runs(samples.package("") and dict(unzip(samples.package(para((props, "x")))))["word/document.xml"], compat=compat)[0]
        return run.fmt["bold"], run.fmt["underline"]

    assert read('<w:b w:val="0"/><w:u w:val="none"/>', True) == (True, "single")
    assert read('<w:b w:val="0"/><w:u w:val="none"/>', False) == (False, "")
    assert read('<w:b w:val="False"/><w:u w:val="double"/>', True) == (False, "double")


def test_missing_ids():
    xml = dict(unzip(samples.package("<w:p><w:r><w:t>a</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p>")))["word/document.xml"]
    assert [r.para_id for r in read_runs(xml)] == ["00000000", "00000001"]
    assert [r.para_id for r in read_runs(xml, compat=True)] == ["unknown", "unknown"]


@pytest.mark.parametrize("lengths,expected", [([400, 500, 300, 1500, 10, 990, 1], [0, 0, 1, 2, 3, 3, 4]), ([1500], [0]), ([1000, 1], [0, 1]), ([0, 0], [0, 0])])
def test_packing(spark, lengths, expected):
    rows = spark.createDataFrame([("d", i, n) for i, n in enumerate(lengths)], "doc string, ord int, n long")
    assert [r["chunk_idx"] for r in pack_chunks(rows, ["doc"], "ord", "n").orderBy("ord").collect()] == expected


def test_packing_keeps_order_and_bounds(spark):
    rows = spark.range(400).select((F.col("id") % 3).alias("doc"), F.col("id").alias("ord"), (F.xxhash64("id") % 1300).alias("m")).withColumn("n", F.abs("m"))
    chunks: dict = {}
    for r in pack_chunks(rows, ["doc"], "ord", "n").orderBy("doc", "ord").collect():
        chunks.setdefault(r["doc"], {}).setdefault(r["chunk_idx"], []).append((r["line_no"], r["n"]))
    for parts in chunks.values():
        order = sorted(parts)
        assert order == list(range(len(order)))
        for at in order:
            assert [x for x, _ in parts[at]] == list(range(len(parts[at])))
            assert sum(n for _, n in parts[at]) <= 1000 or len(parts[at]) == 1
        for a, b in zip(order, order[1:]):
            held, first = sum(n for _, n in parts[a]), parts[b][0][1]
            assert held > 1000 or first > 1000 or held + first > 1000


def test_rebuild_keeps_text_and_what_is_no_text(spark):
    link = '<w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink>'
    body = para(("<w:b/>", "Bold "), ("", "plain "), ("", "more")).replace("</w:p>", link + "</w:p>")
    made = packages(spark, body)
    chunks, registries = documents.extract(docx.runs(made))
    rebuilt = documents.rebuild(made, chunks.select("doc_hash", "para_id", "text"), registries).first()["content"]
    xml = dict(unzip(bytes(rebuilt)))["word/document.xml"].decode()
    assert [r.text for r in read_runs(xml.encode())] == ["Bold ", "plain more"]
    assert "hyperlink" in xml and xml.count("<w:b />") == 1
    compat = documents.rebuild(made, chunks.select("doc_hash", "para_id", "text"), registries, compat=True).first()["content"]
    assert b"hyperlink" not in dict(unzip(bytes(compat)))["word/document.xml"]


def test_rebuild_with_edits_formulas_and_unknown_categories(spark):
    made = packages(spark, para(("", "one two"), ("<w:b/>", "b"), ("", "c")))
    _, registries = documents.extract(docx.runs(made))
    doc = made.first()["doc_hash"]
    texts = spark.createDataFrame([(doc, "00000001", "new $x^2$ ‹F1:b›bold‹/› ‹F7:x›odd‹/›")], "doc_hash string, para_id string, text string")
    xml = dict(unzip(bytes(documents.rebuild(made, texts, registries).first()["content"])))["word/document.xml"]
    runs = read_runs(xml)
    assert [(r.text, r.formulas, bool(r.fmt and r.fmt["bold"])) for r in runs] == [("new ", [], False), ("", ["$x^{2}$"], False), (" ", [], False), ("bold", [], True), (" ", [], False), ("odd", [], False)]


def test_equation_paragraph(spark):
    tab = "<w:r><w:tab/></w:r>"
    body = f'<w:p w14:paraId="0000000A">{tab}<w:r><w:t>x</w:t></w:r>{tab}</w:p>'
    made = packages(spark, body)
    texts = spark.createDataFrame([(made.first()["doc_hash"], "0000000A", r"$$y=1 \tag{3}$$")], "doc_hash string, para_id string, text string")
    none = spark.createDataFrame([], "doc_hash string, registry string")
    xml = dict(unzip(bytes(documents.rebuild(made, texts, none).first()["content"])))["word/document.xml"].decode()
    assert xml.index("oMath") < xml.rindex("<w:tab") < xml.index("(3)")


def test_chunk_files(spark, tmp_path):
    rows = spark.createDataFrame([("d", 0, 0, "0000000A", "first"), ("d", 0, 1, "0000000B", "second"), ("d", 1, 0, "0000000C", "third")], "doc string, chunk_idx int, line_no int, para_id string, text string")
    chunk_files.write_files(chunk_files.chunk_files(rows, "doc"), f"file://{tmp_path}", "doc")
    assert (tmp_path / "d" / "chunk_0.md").read_text() == "[0000000A] first\n[0000000B] second"
    back = chunk_files.paragraph_map(chunk_files.read_lines(spark, str(tmp_path / "d")))
    assert {r["para_id"]: r["text"] for r in back.collect()} == {"0000000A": "first", "0000000B": "second", "0000000C": "third"}


def test_files_of_an_earlier_run_go_and_failed_ones_leave_nothing(spark, tmp_path):
    rows = lambda names: spark.createDataFrame([(n, f"of {n}", "d") for n in names], "file_name string, content string, folder string")
    there = lambda: sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*") if p.is_file())
    root = f"file://{tmp_path}"
    assert chunk_files.write_files(rows(["chunk_0.md", "chunk_1.md", "chunk_2.md", "other.md"]), root, "folder", replaces="chunk_*.md") == (4, 50)
    assert chunk_files.write_files(rows(["chunk_0.md"]), root, "folder", replaces="chunk_*.md") == (1, 13)
    assert there() == ["d/chunk_0.md", "d/other.md"]
    bad = rows(["chunk_5.md", "chunk_6.md"]).withColumn("content", F.when(F.col("file_name") == "chunk_6.md", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        chunk_files.write_files(bad, root, "folder", replaces="chunk_*.md")
    assert there() == ["d/chunk_0.md", "d/other.md"] and not list(tmp_path.glob(".writing-*"))
    assert chunk_files.write_files(rows([]), root, "folder", replaces="chunk_*.md") == (0, 0) and len(there()) == 2


def test_lines_and_ids(spark, tmp_path):
    (tmp_path / "chunk_2.md").write_text("[AB]   lead\n\n[CD]\n[EF] x\r\nno id\n[11] old\n")
    (tmp_path / "chunk_10.md").write_text("[11] new\n[EE]")
    lines = chunk_files.read_lines(spark, str(tmp_path))
    assert lines.where("file_name = 'chunk_2.md'").count() == 6
    assert {r["para_id"]: r["text"] for r in chunk_files.paragraph_map(lines).collect()} == {"AB": "lead", "CD": "", "EF": "x", "11": "old"}


NESTED = ('<w:p w14:paraId="0000000A"><w:pPr/><w:r><w:drawing><w:txbx><w:p w14:paraId="0000000B"><w:r><w:t>in</w:t></w:r></w:p><w:p/></w:txbx></w:drawing></w:r><w:r><w:t>out</w:t></w:r></w:p>'
          '<!-- <w:p> --><w:p w14:paraId="0000000B"><w:r><w:t>é &lt;w:p&gt;</w:t></w:r></w:p><w:p w14:paraId="0000000C"/><w:p\n w14:paraId=\'0000000D\' w:x="a>b" />')


def test_spans_are_the_outermost_paragraphs_as_they_stand():
    xml = dict(unzip(samples.package(NESTED)))["word/document.xml"]
    found = wordml.spans(xml)
    assert [x.para_ids for x in found] == [["0000000A", "0000000B", "00000002"], ["0000000B"], ["0000000C"], ["0000000D"]]
    assert all(xml[x.begin:x.end].decode() == x.xml for x in found) and b"".join(xml[x.begin:x.end] for x in found) == NESTED.replace("<!-- <w:p> -->", "").encode()
    other = xml.replace(b"w14:", b"x:").replace(b"xmlns:w14", b"xmlns:x").replace(b"<w:", b"<q:").replace(b"</w:", b"</q:").replace(b"xmlns:w=", b"xmlns:q=")
    assert [x.para_ids for x in wordml.spans(other)] == [x.para_ids for x in found]
    wide = '<?xml version="1.0" encoding="UTF-16"?>'.encode("utf-16") + xml.decode().encode("utf-16-le")
    assert [x.xml for x in wordml.spans(wordml.as_utf8(wide))] == [x.xml for x in found]


def restored(spark, body, texts, order=("text",), **options):
    made = packages(spark, body)
    rows = spark.createDataFrame([(made.first()["doc_hash"], *x) for x in texts], "doc_hash string, para_id string, text string, file_name string, line_no int")
    none = spark.createDataFrame([], "doc_hash string, registry string")
    return dict(unzip(bytes(documents.rebuild(made, rows, none, order=order, **options).first()["content"])))["word/document.xml"].decode()


def test_repeated_ids_take_the_last_edit_by_file_and_line(spark):
    rows = [("0000000B", "first", "chunk_9.md", 1), ("0000000b", "last", "chunk_9.md", 3), ("0000000B", "early", "chunk_10.md", 9)]
    for some in (rows, rows[::-1]):
        xml = restored(spark, NESTED, some, ["file_name", "line_no"])
        assert xml.count("last") == 2 and "first" not in xml and "early" not in xml and "out" in xml and "<!-- <w:p> -->" in xml
    assert restored(spark, NESTED, rows) == restored(spark, NESTED, rows[::-1])


def test_paragraphs_in_paragraphs_and_what_is_not_edited(spark):
    xml = restored(spark, NESTED, [("0000000A", "new", "f", 1), ("0000000B", "inner", "f", 2)])
    assert xml.count("inner") == 2 and "new" in xml and "out" not in xml and "drawing" in xml
    plain = dict(unzip(samples.package(NESTED)))["word/document.xml"].decode()
    assert restored(spark, NESTED, [("0000000F", "nobody", "f", 1)]) == plain
    edited = restored(spark, NESTED, [("0000000C", "c", "f", 1)])
    assert edited.replace('<w:p w14:paraId="0000000C"><w:r><w:t>c</w:t></w:r></w:p>', '<w:p w14:paraId="0000000C"/>') == plain


def test_a_document_of_very_many_paragraphs(spark):
    n = 100_000
    made = packages(spark, "".join(samples.paragraph_xml(i, [("", "t")]) for i in range(n)))
    texts = spark.range(n).selectExpr("lpad(hex(id), 8, '0') AS para_id", "concat('n', id) AS text").withColumn("doc_hash", F.lit(made.first()["doc_hash"]))
    none = spark.createDataFrame([], "doc_hash string, registry string")
    before = documents.BROADCAST
    documents.BROADCAST = 0  # as if the new paragraphs were too many to be sent to the packages
    try:
        xml = dict(unzip(bytes(documents.rebuild(made, texts, none).first()["content"])))["word/document.xml"].decode()
    finally:
        documents.BROADCAST = before
    assert [x for x in xml.split("<w:t>")[1:3]] == [f'n{i}</w:t></w:r></w:p><w:p w14:paraId="{i + 1:08X}"><w:r>' for i in (0, 1)] and xml.count("<w:t>n") == n
