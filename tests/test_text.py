"""Worked examples of expressions over text, of checks and lookups."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from pagewright.functions import omml, text
from pagewright.operators import checks, lookups


def value(spark, expression, *given):
    names = [f"c{i}" for i in range(len(given))]
    frame = spark.createDataFrame([given], ", ".join(f"{n} string" for n in names))
    return frame.select(expression(*map(F.col, names)).alias("v")).first()["v"]


def test_para_ids(spark):
    strict = lambda x: value(spark, text.strict_para_id, x)
    assert (strict("[0a1b2c3d] x"), strict("[0A1B2C] x"), strict(None)) == ("0A1B2C3D", None, None)
    lenient = lambda x: value(spark, text.parse_line, x)
    assert tuple(lenient("[0A1B2C] x")) == ("0A1B2C", "x")
    assert tuple(lenient("[AB]   lead")) == ("AB", "lead")
    assert tuple(lenient("[AB]\n")) == ("AB", "")
    assert lenient("[AB]") is None


@pytest.mark.parametrize("line,rules", [("<b=1>x</b=1>", []), ("<i>y</b>", ["TAG_MISMATCH"]), ("</b>", ["TAG_EXTRA_CLOSE"]), ("<b>", ["TAG_UNCLOSED"]), ("<f=Times New Roman>", []), ("<b></i></b><u><s>", ["TAG_MISMATCH", "TAG_EXTRA_CLOSE", "TAG_UNCLOSED", "TAG_UNCLOSED"])])
def test_tag_faults(spark, line, rules):
    assert [f["rule"] for f in value(spark, text.tag_faults, line)] == rules


def test_tag_types(spark):
    assert value(spark, text.tag_types, "<b=1>x</b=1> <f=黑体,i=2>y</f=黑体,i=2> <u=3><s=4>z</s=4></u=3> <c=5>w</c=6>") == ["b=1", "f=黑体", "i=2", "s=4"]


def test_segments(spark):
    got = lambda x: [tuple(s) for s in value(spark, text.segments, x)]
    assert got("Hello ‹F1:b›world‹/›!") == [("Hello ", None), ("world", "F1"), ("!", None)]
    assert got("‹F1:b›‹/›") == []
    assert got("a‹F1:b›c") == [("a‹F1:b›c", None)]


@pytest.mark.parametrize("given,expected", [("$x$", (True, "$x$", None)), ("$x$ (1)", (True, "$x$", "(1)")), ("a $x$", (False, "a $x$", None)), ("$x$ and $y$", (False, "$x$ and $y$", None)), ("$$ab$$", (True, "$$ab$$", None))])
def test_formula_only(spark, given, expected):
    assert tuple(value(spark, text.formula_only, given)) == expected


def test_math(spark):
    compat = lambda x: value(spark, lambda c: text.math_to_latex(c, compat=True), x)
    assert compat("20°C → 3 × 4") == r"20^\circC \rightarrow 3 \times 4"
    fixed = lambda x: value(spark, text.math_to_latex, x)
    assert fixed("20°C → $αx × 2$") == r"20°C → $\alpha x \times 2$"


def outline(x):
    name = omml.local(x.tag)
    if name.endswith("Pr"):
        return ""
    if name == "t":
        return x.text
    inside = " ".join(s for s in map(outline, x) if s)
    return inside if name == "r" else f"{name}({inside})"


@pytest.mark.parametrize("latex,compat,fixed", [
    ("x_i^2", "sSubSup(e(x) sub(i) sup(2))", None), (r"\alpha_{i}", "sSub(e(α) sub(i))", None), (r"\leq", "", "≤"), ("3.14", "3 14", "3 . 14"),
    ("ab^2", "ab 2", "a sSup(e(b) sup(2))"), ("ab_c", "ab c", "a sSub(e(b) sub(c))"), (r"x_\alpha", "sSub(e(x) sub(alpha))", "sSub(e(x) sub(α))"), ("mu_{x}", "sSub(e(μ) sub(x))", "m sSub(e(u) sub(x))"),
    (r"\frac{1}{2}", "f(num(1) den(2))", None), (r"\sqrt{x}", "rad(deg() e(x))", None), (r"\sqrt[3]{x}", "rad(deg() e([)) 3 ] { x }", "rad(deg(3) e(x))"),
    (r"\begin{cases}x&y\\z\end{cases}", "d(e(x   z))", None), (r"\vec{a}", "acc(e(a))", None), (r"(a+b)^{2}", "sSup(e(( a + b )) sup(2))", None), ("", "", None), ("$$x$$", "x", None)])
def test_latex(latex, compat, fixed):
    assert outline(omml.to_omml(latex, compat=True)) == f"oMath({compat})"
    assert outline(omml.to_omml(latex)) == f"oMath({compat if fixed is None else fixed})"


def test_long_formulas_do_not_nest_calls():
    assert outline(omml.to_omml("x+" * 5000)).count("+") == 5000


@pytest.mark.parametrize("latex", [r"\frac{1}{2}", "x_{i}^{2}", r"\sqrt[3]{y}", r"\sqrt{y}", "a_{b}"])
def test_latex_round_trip(latex):
    assert omml.to_latex(ET.fromstring(ET.tostring(omml.to_omml(latex)))) == latex


LINES = "file_name string, line_no int, line string"


def test_verify_of_equal_sides_finds_nothing(spark):
    rows = spark.createDataFrame([("chunk_0.md", 0, "[00000001] <b=1>x</b=1>"), ("chunk_0.md", 1, "[00000002] y")], LINES)
    assert checks.verify(rows, rows).count() == 0
    assert checks.report(checks.verify(rows, rows)).first()["passed"]


def test_verify(spark):
    edited = spark.createDataFrame([("a", 0, "[00000001] x"), ("a", 1, "no id"), ("b", 0, "[00000001] x")], LINES)
    origin = spark.createDataFrame([("a", 0, "[00000002] <b=1>x</b=1>"), ("a", 1, "[00000001]"), ("a", 2, "[00000003]"), ("c", 0, "z")], LINES)
    found = {(r["file_name"], r["line_no"], r["rule"], r["detail"]) for r in checks.verify(edited, origin).collect()}
    assert found == {("a", 0, "ID_MISMATCH", "00000001 00000002"), ("a", 0, "TAG_TYPE_MISSING", "b=1"), ("a", 1, "CHUNK_NO_ID", None), ("a", 2, "CHUNK_LINE_MISSING", None),
                     ("a", None, "LINE_COUNT", "2 3"), ("b", None, "ONLY_IN_CHUNKS", None), ("c", None, "ONLY_IN_ORIGIN", None)}
    none = spark.createDataFrame([], LINES)
    assert {r["rule"] for r in checks.verify(edited, none).collect()} == {"ONLY_IN_CHUNKS", "FILE_COUNT", "NO_COMMON_FILES"}


def test_lookup_falls_back_only_for_unknown_paragraphs(spark):
    wanted = spark.createDataFrame([("P1", "F1"), ("P2", "F1"), ("P1", "F0")], "para_id string, cat_id string")
    own = spark.createDataFrame([("P1", "F0", "own")], "para_id string, cat_id string, rpr string")
    overall = spark.createDataFrame([("F1", "all")], "cat_id string, rpr string")
    got = {(r["para_id"], r["cat_id"]): r["rpr"] for r in lookups.lookup_formats(wanted, own, overall, ["para_id"], "rpr").collect()}
    assert got == {("P1", "F1"): None, ("P2", "F1"): "all", ("P1", "F0"): "own"}


def test_registries_of_both_forms(spark):
    new = '{"doc_hash":"d","paragraphs":{"0a":{"baseline":"F1","categories":{"F0":{"label":"l","rpr_xml":"<x/>","count":2}}}}}'
    old = '{"baseline":"F0","categories":{"F0":{"rpr_xml":"<y/>"}}}'
    frame = spark.createDataFrame([("new", new), ("old", old)], "name string, registry string")
    got = {tuple(r) for r in lookups.registry_rows(F.col("registry"), frame, ["name"]).collect()}
    assert got == {("new", "0A", "F1", "F0", "l", "<x/>", 2), ("old", None, "F0", "F0", None, "<y/>", None)}
