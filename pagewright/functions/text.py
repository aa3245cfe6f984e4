"""Expressions over lines of text: paragraph ids, tags, formulas, segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mathematical characters and their LaTeX.
MATH = {
    "∈": r"\in", "∉": r"\notin", "⊂": r"\subset", "⊆": r"\subseteq", "∪": r"\cup", "∩": r"\cap", "∅": r"\emptyset", "∞": r"\infty",
    "∑": r"\sum", "∏": r"\Pi", "∫": r"\int", "∂": r"\partial", "∇": r"\nabla", "√": r"\sqrt", "∆": r"\Delta",
    "Σ": r"\Sigma", "Ω": r"\Omega", "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "ε": r"\epsilon", "θ": r"\theta",
    "λ": r"\lambda", "μ": r"\mu", "π": r"\pi", "ρ": r"\rho", "σ": r"\sigma", "τ": r"\tau", "φ": r"\phi", "ω": r"\omega",
    "→": r"\rightarrow", "←": r"\leftarrow", "↔": r"\leftrightarrow", "⇒": r"\Rightarrow", "⇐": r"\Leftarrow", "⇔": r"\Leftrightarrow",
    "≤": r"\leq", "≥": r"\geq", "≠": r"\neq", "≈": r"\approx", "≡": r"\equiv", "±": r"\pm", "∓": r"\mp",
    "×": r"\times ", "÷": r"\div ", "·": r"\cdot ", "ℝ": r"\mathbb{R}", "ℕ": r"\mathbb{N}", "ℤ": r"\mathbb{Z}", "ℂ": r"\mathbb{C}",
    "°": r"^\circ", "′": "'", "″": r"\prime\prime",
}
SPACED = ("times", "div", "cdot")
# The forms of formulas, of characters that XML must not hold, of tags' names, and of tags of categories.
DELIMITED = r"\$\$[^$].*?\$\$|\$[^$]+\$"
ILLEGAL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
TAG_NAME = r"[fisbzchuv,=\w]"
CATEGORY_TAG = r"‹(F\d+):[^›]*›([^‹]*)‹/›"
FORMULA_ONLY = r"(\$\$[^$].*?\$\$|\$[^$]+\$)(\s*\([^)]*\))?$"


def _commands(text: Column, apart: bool) -> Column:
    """One pass: what is known, with the letter after it, and the gaps between, each looked up once. ``apart``: a letter must not run into the command."""
    known = "".join(MATH)
    tokens = F.regexp_extract_all(text, F.lit(f"(?s)[{known}][A-Za-z]?|[^{known}]+"), F.lit(0))
    commands = F.create_map(*(F.lit(x) for pair in MATH.items() for x in pair))

    def told(token: Column) -> Column:
        command = F.try_element_at(commands, F.left(token, F.lit(1)))
        space = F.when((F.length(token) > 1) & F.rlike(command, F.lit("[A-Za-z]$")), " ").otherwise("") if apart else F.lit("")
        return F.coalesce(F.concat(command, space, F.substring(token, F.lit(2), F.lit(1))), token)

    text = F.array_join(F.transform(tokens, told), "")
    for name in SPACED:
        text = F.regexp_replace(text, rf"(?U)\\{name}\s+", rf"\\{name} ")
    return text


def math_to_latex(text: Column, *, compat: bool = False) -> Column:
    """Mathematical characters as LaTeX: within ``$`` only; with ``compat``, everywhere."""
    if compat:
        return _commands(text, False)
    parts = F.transform(split_formulas(text), lambda p: F.when(p["is_formula"], _commands(p["text"], True)).otherwise(p["text"]))
    return F.when(F.contains(text, F.lit("$")), F.array_join(parts, "")).otherwise(text)


def split_formulas(text: Column) -> Column:
    """The text in order as an array of (text, is_formula), empty parts left out; formulas keep their delimiters."""
    pattern = F.lit(f"(?s){DELIMITED}")
    formulas = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, f"(?s){DELIMITED}", -1)
    # each list is made once: within a function over the other it would be made again for every part
    woven = F.flatten(F.zip_with(gaps, formulas, lambda gap, formula: F.array(
        F.struct(gap.alias("text"), F.lit(False).alias("is_formula")),
        F.struct(F.coalesce(formula, F.lit("")).alias("text"), F.lit(True).alias("is_formula")))))
    return F.filter(woven, lambda p: p["text"] != "")


def formula_only(text: Column) -> Column:
    """(is_formula, formula, tag) of a text that is one formula and, maybe, a tag in parentheses."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    whole = "(?d)^" + FORMULA_ONLY.replace(r"\s*", r"(?U:\s*)")
    formula = F.regexp_extract(bare, whole, 1)
    tag = F.nullif(F.regexp_replace(F.regexp_extract(bare, whole, 2), r"(?U)^\s+|\s+$", ""), F.lit(""))
    inner = F.when(F.startswith(formula, F.lit("$$")), F.substring(formula, F.lit(3), F.greatest(F.length(formula) - 4, F.lit(0)))).otherwise(
        F.substring(formula, F.lit(2), F.greatest(F.length(formula) - 2, F.lit(0))))
    good = (formula != "") & ~F.contains(inner, F.lit("$"))
    return F.struct(F.coalesce(good, F.lit(False)).alias("is_formula"), F.when(good, formula).otherwise(text).alias("formula"), F.when(good, tag).alias("tag"))


def strict_para_id(line: Column) -> Column:
    """The upper-cased id of a line that begins with exactly eight hexadecimal digits in brackets; else null."""
    return F.upper(F.nullif(F.regexp_extract(line, r"^\[([0-9A-Fa-f]{8})\]", 1), F.lit("")))


def parse_line(line: Column) -> Column:
    """(para_id, text) of a line whose id may have any length; null if the line has none. ``line`` keeps its line break, if it had one."""
    pattern = r"(?s)^\[([A-Fa-f0-9]+)\](?U:\s+)(.*)$"
    bare = F.regexp_replace(line, r"(?U)^\s+", "")
    found = F.rlike(bare, F.lit(pattern))
    return F.when(found, F.struct(F.upper(F.regexp_extract(bare, pattern, 1)).alias("para_id"), F.regexp_replace(F.regexp_extract(bare, pattern, 2), r"\n+$", "").alias("text")))


def chunk_line(para_id: Column, text: Column) -> Column:
    return F.concat(F.lit("["), para_id, F.lit("] "), text)


def xml_legal(text: Column) -> Column:
    return F.regexp_replace(text, ILLEGAL, "")


def is_blank(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s", "") == ""


def tag_types(line: Column) -> Column:
    """The distinct ``attribute=value`` items of all ``<items>...</items>`` pairs, sorted."""
    names = F.regexp_extract_all(line, F.lit(rf"(?U)<({TAG_NAME}+)>([^<]*)</\1>"), F.lit(1))
    items = F.flatten(F.transform(names, lambda x: F.split(x, ",")))
    return F.array_sort(F.array_distinct(F.filter(items, lambda x: F.contains(x, F.lit("=")))))


_TOKEN = "struct<name:string,closes:boolean,sum:int,low:int>"
_PLACED = "struct<level:int,at:int,closes:boolean,name:string>"


def _sums(tokens: Column) -> Column:
    """Tokens with ``sum``: all steps so far added up, and ``low``: the least sum so far, or 0. Each round adds what is twice as far back, so it takes as many as the number of tokens has digits."""
    def add(before: Column, token: Column) -> Column:
        return F.struct(token["name"].alias("name"), token["closes"].alias("closes"), (before["sum"] + token["sum"]).alias("sum"), F.least(before["low"], before["sum"] + token["low"]).alias("low"))

    def further(sums: Column, far: Column) -> Column:
        none = F.struct(F.lit("").alias("name"), F.lit(False).alias("closes"), F.lit(0).alias("sum"), F.lit(0).alias("low"))
        back = F.concat(F.array_repeat(none, far), F.slice(sums, F.lit(1), F.size(sums) - far))
        return F.zip_with(back, sums, add)

    # a number of n binary digits is at most so many steps away from the first
    rounds = F.transform(F.sequence(F.lit(0), F.length(F.bin(F.greatest(F.size(tokens) - 1, F.lit(0)))) - 1), lambda i: F.pow(F.lit(2), i).cast("int"))
    return F.aggregate(F.filter(rounds, lambda far: far < F.size(tokens)), tokens, lambda sums, far: further(sums, far).cast(f"array<{_TOKEN}>"))


#: A line of no more ``<`` is gone through by a fold, which is faster where tags are few.
FEW = 1000


def tag_faults(line: Column) -> Column:
    """Faults of the line's tags, in order, as (rule, found, expected): an extra close, a close that does not match, a tag left open. A close takes the last open tag even if it does not match."""
    none = F.array().cast("array<struct<rule:string,found:string,expected:string>>")
    few = F.length(line) - F.length(F.replace(line, F.lit("<"), F.lit(""))) <= FEW
    return F.when(~F.contains(line, F.lit("<")), none).when(few, folded_faults(line)).otherwise(placed_faults(line))


def folded_faults(line: Column) -> Column:
    """``tag_faults`` by a fold over the tags with the open ones as a stack.

    Spark copies a fold's state at each step, item by item, so stack and faults are strings, which are copied at once: names that end in ``>``, and faults of a letter and names, with spaces, which no name holds.
    """
    found = F.regexp_extract_all(line, F.lit(rf"(?U)</?{TAG_NAME}*>"), F.lit(0))
    tokens = F.transform(found, lambda x: F.struct(F.startswith(x, F.lit("</")).alias("closes"), F.regexp_replace(x, "^</?", "").alias("name")))

    def step(state: Column, token: Column) -> Column:
        (closes, name), (stack, faults) = (token["closes"], token["name"]), (state["open"], state["faults"])
        top = F.substring_index(stack, ">", -2)
        shorter = F.left(stack, F.length(stack) - F.length(top))
        told = (F.when(closes & (stack == ""), F.concat(faults, F.lit("x "), name))
                .when(closes & (top != name), F.concat(faults, F.lit("m "), F.rtrim(name, F.lit(">")), F.lit(" "), top)).otherwise(faults))
        return F.struct(F.when(closes, shorter).otherwise(F.concat(stack, name)).alias("open"), told.alias("faults"))

    def listed(joined: Column) -> Column:
        parts = F.split(joined, ">")
        return F.slice(parts, F.lit(1), F.size(parts) - 1)

    def fault(words: Column) -> Column:
        rule = F.when(words[0] == "x", "TAG_EXTRA_CLOSE").when(words[0] == "m", "TAG_MISMATCH").otherwise("TAG_UNCLOSED")
        return F.struct(rule.alias("rule"), words[1].alias("found"), F.get(words, F.lit(2)).alias("expected"))

    def finish(state: Column) -> Column:
        unclosed = F.transform(listed(state["open"]), lambda x: F.array(F.lit("u"), x))
        return F.transform(F.concat(F.transform(listed(state["faults"]), lambda x: F.split(x, " ")), unclosed), fault)

    return F.aggregate(tokens, F.struct(F.lit("").alias("open"), F.lit("").alias("faults")), step, finish)


def placed_faults(line: Column) -> Column:
    """``tag_faults`` by depth, in time that does not grow with the square.

    A close takes the last open tag even if it does not match, so tags are paired by depth alone: the sum of opens less closes, less what it fell below 0. Sorted by depth and place, an open
    tag stands before the close that takes it; a close with none before it at its depth is extra, an open tag with none after it is left open.
    """
    found = F.regexp_extract_all(line, F.lit(rf"(?U)</?{TAG_NAME}*>"), F.lit(0))

    def token(tag: Column) -> Column:
        closes = F.startswith(tag, F.lit("</"))
        return F.struct(F.regexp_replace(tag, "^</?|>$", "").alias("name"), closes.alias("closes"), F.when(closes, -1).otherwise(1).alias("sum"), F.when(closes, -1).otherwise(0).alias("low")).cast(_TOKEN)

    def place(x: Column, at: Column) -> Column:
        return F.struct((x["sum"] - x["low"] + x["closes"].cast("int")).alias("level"), at.alias("at"), x["closes"].alias("closes"), x["name"].alias("name")).cast(_PLACED)

    def fault(left: Column, right: Column) -> Column:
        told = lambda last, at, rule, name, expected: F.struct(F.lit(last).alias("last"), at.alias("at"), F.lit(rule).alias("rule"), name.alias("found"), expected.cast("string").alias("expected"))
        beside = F.coalesce(left["level"] == right["level"], F.lit(False))
        taken = beside & ~F.coalesce(left["closes"], F.lit(True))
        return (F.when(right["closes"] & ~taken, told(0, right["at"], "TAG_EXTRA_CLOSE", right["name"], F.lit(None)))
                .when(right["closes"] & (left["name"] != right["name"]), told(0, right["at"], "TAG_MISMATCH", right["name"], left["name"]))
                .when(~left["closes"] & ~beside, told(1, left["at"], "TAG_UNCLOSED", left["name"], F.lit(None))))

    none = F.array(F.lit(None).cast(_PLACED))
    sorted_once = F.array(F.array_sort(F.transform(_sums(F.transform(found, token)), place)))  # a list of one list, so that each use of it in the function is of what was made once
    faults = F.transform(sorted_once, lambda tags: F.zip_with(F.concat(none, tags), F.concat(tags, none), fault))[0]
    listed = F.array_sort(F.filter(faults, lambda f: f.isNotNull()))
    return F.when(line.isNotNull(), F.transform(listed, lambda f: F.struct(f["rule"].alias("rule"), f["found"].alias("found"), f["expected"].alias("expected"))))


def segments(text: Column) -> Column:
    """The text in order as an array of (text, cat_id): tagged parts have their category's id; tags without text are left out, markup that is no whole tag stays text."""
    names = F.regexp_extract_all(text, F.lit(CATEGORY_TAG), F.lit(1))
    inner = F.regexp_extract_all(text, F.lit(CATEGORY_TAG), F.lit(2))
    gaps = F.split(text, CATEGORY_TAG, -1)
    part = lambda t, c: F.struct(t.alias("text"), c.alias("cat_id"))
    tags = F.zip_with(names, inner, lambda name, held: part(held, name))
    woven = F.flatten(F.zip_with(gaps, tags, lambda gap, tag: F.array(part(gap, F.lit(None).cast("string")), part(F.coalesce(tag["text"], F.lit("")), tag["cat_id"]))))
    return F.filter(woven, lambda p: p["text"] != "")


def equation_tag(formula: Column) -> Column:
    r"""(formula, tag) of a formula with ``\tag{n}``: what stands before it, and ``(n)``."""
    number = F.nullif(F.regexp_extract(formula, r"\\tag\{([^}]+)\}", 1), F.lit(""))
    before = F.regexp_replace(F.regexp_extract(formula, r"(?s)^(.*?)\\tag\{[^}]+\}", 1), r"(?U)\s+$", "")
    return F.struct(F.when(number.isNotNull(), before).otherwise(formula).alias("formula"), F.when(number.isNotNull(), F.concat(F.lit("("), number, F.lit(")"))).alias("tag"))


def format_parts(text: Column, formats: Column, baseline: Column, *, compat: bool = False) -> Column:
    """The text in order as an array of (is_formula, text, props): tagged parts with the properties that ``formats``, a map by category, has for them, others with ``baseline``.

    ``compat``: formulas part the text first, so tags around one become text.
    """
    props = lambda cat: F.when(cat.isNull(), baseline).otherwise(F.try_element_at(formats, cat))
    part = lambda formula, t, p: F.struct(formula.alias("is_formula"), t.alias("text"), p.alias("props"))
    if compat:
        of_text = lambda t: F.transform(segments(t), lambda s: part(F.lit(False), s["text"], props(s["cat_id"])))
        return F.flatten(F.transform(split_formulas(text), lambda p: F.when(p["is_formula"], F.array(part(F.lit(True), p["text"], F.lit(None).cast("string")))).otherwise(of_text(p["text"]))))
    return F.flatten(F.transform(segments(text), lambda s: F.transform(split_formulas(s["text"]), lambda p: part(p["is_formula"], p["text"], props(s["cat_id"])))))
