"""Formulas: Office MathML to LaTeX and back."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
ET.register_namespace("w", W[1:-1])
ET.register_namespace("m", M[1:-1])

# Commands for Greek letters, and names that are set upright.
GREEK = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "iota": "ι", "kappa": "κ", "lambda": "λ",
    "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
}
CALLED = "arctan arcsin arccos cos sin tan cot log ln exp lim max min sup inf".split()
NAMED = {*CALLED, "sec", "csc"}
SIGNS = "=+-*/()[]{},;: |'"
ILLEGAL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


# Office MathML to LaTeX


def to_latex(element: ET.Element) -> str:
    """Text, scripts, fractions and roots as LaTeX; what else there is, by what it holds."""
    name = local(element.tag)
    inside = lambda x: "".join(map(to_latex, x)) if x is not None else ""
    if name == "t":
        return (element.text or "").replace("{", r"\{").replace("}", r"\}")
    if name in ("sub", "sup"):
        held = inside(element)
        return f"{'_' if name == 'sub' else '^'}{{{held}}}" if held else ""
    if name == "f":
        return rf"\frac{{{inside(element.find(M + 'num'))}}}{{{inside(element.find(M + 'den'))}}}"
    if name == "rad":
        degree = inside(element.find(M + "deg"))
        return rf"\sqrt{f'[{degree}]' if degree else ''}{{{inside(element.find(M + 'e'))}}}"
    return inside(element)


# LaTeX to Office MathML


def node(tag: str, *children: ET.Element, **values: str) -> ET.Element:
    out = ET.Element(M + tag, {M + k: v for k, v in values.items()})
    out.extend(children)
    return out


def _fonts(hint: str) -> ET.Element:
    out = ET.Element(W + "rPr")
    ET.SubElement(out, W + "rFonts", {W + "hint": hint, W + "ascii": "Cambria Math", W + "hAnsi": "Cambria Math"})
    return out


def control() -> ET.Element:
    return node("ctrlPr", _fonts("eastAsia"))


def run(text: str, hint: str = "default") -> ET.Element:
    t = node("t")
    t.text = text
    return node("r", node("rPr", node("sty", val="p")), _fonts(hint), t)


def slot(tag: str, children: list[ET.Element]) -> ET.Element:
    return node(tag, *children, control())


def delimited(opening: str, children: list[ET.Element], closing: str) -> ET.Element:
    return node("d", node("dPr", node("begChr", val=opening), node("endChr", val=closing), control()), slot("e", children), control())


def scripted(base: list[ET.Element], sub: list[ET.Element] | None, sup: list[ET.Element] | None) -> ET.Element:
    tag = "sSubSup" if sub is not None and sup is not None else "sSub" if sub is not None else "sSup"
    scripts = [slot(name, x) for name, x in (("sub", sub), ("sup", sup)) if x is not None]
    return node(tag, node(tag + "Pr", control()), slot("e", base), *scripts, control())


def root(degree: list[ET.Element], radicand: list[ET.Element]) -> ET.Element:
    hidden = [] if degree else [node("degHide", val="1")]
    return node("rad", node("radPr", *hidden, control()), slot("deg", degree), slot("e", radicand))


def symbol(name: str) -> ET.Element:
    """A base as a run; a Greek letter's name, with or without a backslash, as the letter."""
    letter = GREEK.get(name.removeprefix("\\"))
    return run(letter, "eastAsia") if letter else run(name)


_CHAR = r"[a-zA-Z0-9\u0080-\uffff]"
_SCRIPT = re.compile(
    # base, subscript and superscript; each script is braced, or one character, or (only after a character) the name of a command
    rf"(?:\\(?P<name>[a-zA-Z]+)|(?P<char>{_CHAR}))"
    rf"(?:_(?:\{{(?P<sub>[^}}]+)\}}|(?P<sub1>{_CHAR})|\\(?P<subname>[a-zA-Z]+)))?"
    rf"(?:\^(?:\{{(?P<sup>[^}}]+)\}}|(?P<sup1>{_CHAR})))?")


class Latex:
    """Reads LaTeX from left to right; ``take`` gives the elements of one run of the text. Only braces nest calls.

    ``compat``: symbols that no rule knows vanish, letters of a longer base are lost before a bare script, a script's
    command stays its name, and a root's degree is not read.
    """

    def __init__(self, compat: bool) -> None:
        self.compat = compat
        self.rules = (self._call, self._parenthesis, self._block, self._braced, self._fraction, self._scripts, self._shut, self._bare_script, self._word_base, self._command, self._sign, self._word)

    def take(self, text: str) -> list[ET.Element]:
        out: list[ET.Element] = []
        text, at = text.strip(), 0
        while at < len(text):
            if text[at].isspace():
                at += 1
                continue
            for rule in self.rules:
                if (end := rule(text, at, out)) is not None:
                    at = end
                    break
            else:
                if not self.compat:
                    out.append(run(text[at]))
                at += 1
        return out

    @staticmethod
    def brace(text: str, at: int) -> tuple[str, int]:
        """What the brace at ``at`` holds, and where it ends; the rest if it never does."""
        depth = 0
        for i in range(at, len(text)):
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            if not depth:
                return text[at + 1:i], i + 1
        return text[at + 1:], len(text)

    _CALL = re.compile(rf"\\({'|'.join(CALLED)})\s*\(([^)]+)\)")

    def _call(self, text, at, out):
        if m := self._CALL.match(text, at):
            out += [run(m[1]), delimited("(", self.take(m[2]), ")")]
            return m.end()

    _ROUND = re.compile(r"\(([^)]+)\)")

    def _parenthesis(self, text, at, out):
        if not (m := self._ROUND.match(text, at)):
            return None
        inner = self.take(m[1])
        whole = [delimited("(", inner, ")")] if "\\" in m[1] else [run("("), *inner, run(")")]
        if text.startswith("^{", m.end()):
            held, end = self.brace(text, m.end() + 1)
            out.append(scripted(whole, None, self.take(held)))
            return end
        out += whole
        return m.end()

    _BLOCK = re.compile(r"\\begin\{(bmatrix|cases)\}(.*?)\\end\{\1\}", re.S)

    def _block(self, text, at, out):
        if not (m := self._BLOCK.match(text, at)):
            return None
        rows = [r.strip() for r in m[2].strip().split("\\\\") if r.strip()]
        if m[1] == "cases":
            inside: list[ET.Element] = []
            for i, row in enumerate(rows):
                inside += ([run(" ")] if i else []) + self.take(row.split("&")[0])
            out.append(delimited("{", inside, ""))
        else:
            columns = node("mcs", node("mc", node("mcPr", node("count", val="1" if self.compat else str(max([1, *(r.count("&") + 1 for r in rows)]))), node("mcJc", val="center"))))
            lines = [node("mr", *(slot("e", self.take(cell)) for cell in row.split("&"))) for row in rows]
            out.append(delimited("[", [node("m", node("mPr", columns, node("plcHide", val="1"), control()), *lines)], "]"))
        return m.end()

    _DEGREE = re.compile(r"\\sqrt\[([^\]]*)\](?=\{)")

    def _braced(self, text, at, out):
        if not self.compat and (m := self._DEGREE.match(text, at)):
            held, end = self.brace(text, m.end())
            out.append(root(self.take(m[1]), self.take(held)))
            return end
        for command in ("sqrt", "vec", "text", "tag"):
            if text.startswith(f"\\{command}{{", at):
                held, end = self.brace(text, at + len(command) + 1)
                if command == "sqrt":
                    out.append(root([], self.take(held)))
                elif command == "vec":
                    out.append(node("acc", node("accPr", node("chr", val="\u20d7"), control()), slot("e", self.take(held))))
                else:
                    out.append(run(held if command == "text" else f"  ({held})"))
                return end

    def _fraction(self, text, at, out):
        if text.startswith("\\frac{", at):
            over, end = self.brace(text, at + 5)
            if text.startswith("{", end):
                under, end = self.brace(text, end)
                out += [node("f", node("fPr", control()), slot("num", self.take(over)), slot("den", self.take(under))), control()]
                return end

    def _scripts(self, text, at, out):
        m = _SCRIPT.match(text, at)
        if not m:
            return None
        if not self.compat and m["char"]:  # the base is the word's last character
            word = self._WORD.match(text, at)
            if word.end() > at + 1 and text[word.end():word.end() + 1] in ("_", "^") and word[0].isascii():
                out.append(run(word[0][:-1]))
                return word.end() - 1
        sub, sup, end = m["sub"] or m["sub1"], m["sup"] or m["sup1"], m.end()
        if m["subname"]:
            if m["name"] and self.compat:
                return None
            sub = m["subname"] if self.compat else "\\" + m["subname"]
        if sub and sup and not self._together(m):
            sup, end = None, m.start("sup" if m["sup"] else "sup1") - (2 if m["sup"] else 1)
        if not (sub or sup):
            return None
        base = symbol(m["name"] or m["char"])
        out.append(scripted([base], self.take(sub) if sub else None, self.take(sup) if sup else None))
        return end

    def _together(self, m) -> bool:
        """Which pairs of scripts are set above each other: both braced, both single, or a command below."""
        return not self.compat or bool(m["subname"] or (m["sub"] and m["sup"]) or (m["sub1"] and m["sup1"]))

    def _shut(self, text, at, out):
        if text[at] in "∥‖()[]{}" and text.startswith("_{", at + 1):
            held, end = self.brace(text, at + 2)
            out.append(scripted([run(text[at])], self.take(held), None))
            return end

    def _bare_script(self, text, at, out):
        sup = not self.compat and text.startswith("^{", at)
        if text.startswith("_{", at) or sup:
            held, end = self.brace(text, at + 1)
            base = [out.pop()] if out else []
            inside = self.take(held)
            out.append(scripted(base, None if sup else inside, inside if sup else None))
            return end

    _LETTERS = re.compile(r"([a-zA-Z]+)_(?=\{)")

    def _word_base(self, text, at, out):
        if m := self._LETTERS.match(text, at):
            held, end = self.brace(text, m.end())
            out.append(scripted([symbol(m[1])], self.take(held), None))
            return end

    _NAME = re.compile(r"\\([a-zA-Z]+)")

    def _command(self, text, at, out):
        if not (m := self._NAME.match(text, at)):
            return None
        name, end = m[1], m.end()
        if name in GREEK:
            out.append(symbol(name))
        elif name == "quad":
            out.append(run("\u2003"))
        elif name in ("cdot", "times"):
            out.append(run("⋅" if self.compat or name == "cdot" else "×"))
        elif name in NAMED:
            out.append(run(name))
        elif name == "sqrt":
            if end < len(text):
                out.append(root([], self.take(text[end])))
                end += 1
        elif not self.compat:
            out.append(run(UNICODE.get(name, name)))
        return end

    def _sign(self, text, at, out):
        if text[at] in SIGNS:
            out.append(run(text[at]))
            return at + 1

    _WORD = re.compile(rf"{_CHAR}+")

    def _word(self, text, at, out):
        if m := self._WORD.match(text, at):
            out.append(run(m[0], "eastAsia" if m[0] in GREEK.values() else "default"))
            return m.end()


def _names() -> dict[str, str]:
    from .text import MATH

    return {command.strip().removeprefix("\\"): char for char, command in MATH.items() if re.fullmatch(r"\\[A-Za-z]+ ?", command)}


UNICODE = _names()


def to_omml(latex: str, *, compat: bool = False) -> ET.Element:
    """The formula, with or without its ``$``, as an oMath element."""
    latex = ILLEGAL.sub("", latex.strip())
    for mark in ("$$", "$"):
        if len(latex) >= 2 * len(mark) and latex.startswith(mark) and latex.endswith(mark):
            latex = latex[len(mark):-len(mark)]
            break
    return node("oMath", *Latex(compat).take(latex))


# As columns


@F.pandas_udf(T.StringType())
def omml_to_latex(xml: pd.Series) -> pd.Series:
    return xml.map(lambda x: to_latex(ET.fromstring(x)), na_action="ignore")


def latex_to_omml(compat: bool = False):
    @F.pandas_udf(T.StringType())
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for latex in batches:
            yield latex.map(lambda x: ET.tostring(to_omml(x, compat=compat), encoding="unicode"), na_action="ignore")

    return convert
