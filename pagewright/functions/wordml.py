"""One document's XML: to rows of runs, and back with edited paragraphs.

``compat`` keeps ways that lose or misread content; each is named where it is used.
"""

from __future__ import annotations

import copy
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple
from xml.parsers import expat

from .omml import W, local, to_latex, to_omml
from .text import FORMULA_ONLY, ILLEGAL

W14 = "{http://schemas.microsoft.com/office/word/2010/wordml}"
SPACE = "{http://www.w3.org/XML/1998/namespace}space"
DOCUMENT = "word/document.xml"
PICTURES = {W + x for x in ("pict", "drawing", "object")}
FORMULAS = ("oMath", "oMathPara")


class Run(NamedTuple):
    para_ord: int
    para_id: str
    run_ord: int
    fmt: dict | None
    rpr_xml: str | None
    text: str
    formulas: list[str]


def unzip(content: bytes) -> list[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        return [(x.filename, package.read(x)) for x in package.infolist() if not x.is_dir()]


def part(content: bytes, name: str) -> bytes | None:
    """One part of a package; the others are not unpacked."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        return package.read(name) if name in package.namelist() else None


def zip_parts(parts: list[tuple[str, bytes]]) -> bytes:
    """The parts as a package, in their order, with fixed times: equal parts give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for name, data in parts:
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_DEFLATED
            package.writestr(info, data)
    return out.getvalue()


def paragraphs(root: ET.Element, compat: bool) -> Iterator[tuple[int, str, ET.Element]]:
    """All paragraphs in document order; one without an id gets one made of its place (``compat``: ``unknown``)."""
    for at, para in enumerate(root.iter(W + "p")):
        yield at, para.get(W14 + "paraId") or ("unknown" if compat else f"{at:08X}"), para


def read_format(run: ET.Element, compat: bool) -> tuple[dict, str | None]:
    """``compat``: properties are looked for at any depth, a switch is off only by ``false``, and an underline of ``none`` is ``single``."""
    look = ".//" if compat else ""
    props = run.find(look + W + "rPr")
    get = lambda name: None if props is None else props.find(look + W + name)
    value = lambda name, key="val": "" if get(name) is None else get(name).get(W + key, "")
    off = ("false",) if compat else ("false", "0", "off")
    switch = lambda name: get(name) is not None and get(name).get(W + "val", "true").lower() not in off
    try:
        size = int(value("sz") or 0)
    except ValueError:
        size = 0
    line = value("u")
    if compat and get("u") is not None and line in ("", "none"):
        line = "single"
    elif not compat:
        line = "" if line == "none" else line or ("single" if get("u") is not None else "")
    fmt = {"font_ascii": value("rFonts", "ascii"), "font_east_asia": value("rFonts", "eastAsia"), "size": size, "bold": switch("b"), "italic": switch("i"), "highlight": value("highlight"),
           "color": value("color"), "underline": line, "strike": switch("strike"), "dstrike": switch("dstrike"), "vert_align": value("vertAlign"), "small_caps": switch("smallCaps")}
    return fmt, None if props is None else ET.tostring(props, encoding="unicode")


def read_text(run: ET.Element, compat: bool) -> tuple[str, list[str]]:
    """The run's text, with formulas of embedded objects in it, and its own formulas."""
    text, formulas = [], []
    for child in run:
        name = local(child.tag)
        if name == "t" and child.text:
            text.append(child.text)
        elif name in FORMULAS:
            formulas += [f"${x}$"] if (x := to_latex(child)) else []
        elif name == "object":
            text += [f"${x}$" for y in child if local(y.tag) in FORMULAS and (x := to_latex(y))]
    whole = "".join(text)
    return (whole if compat else re.sub(r"[\r\n]+", " ", whole)), formulas


def read_runs(xml: bytes, *, compat: bool = False) -> list[Run]:
    """The runs of all paragraphs that hold text or formulas; a formula of its own is a run without a format."""
    out = []
    for para_ord, para_id, para in paragraphs(ET.fromstring(xml), compat):
        at = 0
        for child in para:
            name = local(child.tag)
            if name == "r":
                fmt, rpr = read_format(child, compat)
                text, formulas = read_text(child, compat)
            elif name in FORMULAS:
                fmt = rpr = None
                text, formulas = "", [f"${x}$"] if (x := to_latex(child)) else []
            else:
                continue
            if text or formulas:
                out.append(Run(para_ord, para_id, at, fmt, rpr, text, formulas))
                at += 1
    return out


_ILLEGAL, _ONLY = re.compile(ILLEGAL), re.compile(FORMULA_ONLY)
_NUMBER = re.compile(r"\\tag\{([^}]+)\}")


def outline(xml: bytes) -> Iterator[tuple[int, str]]:
    """Each paragraph's place, and the names of what is in it; of runs, what they hold."""
    for at, _, para in paragraphs(ET.fromstring(xml), False):
        yield at, " ".join(local(x.tag) + (f"({','.join(local(y.tag) for y in x)})" if local(x.tag) == "r" else "") for x in para)


def text_run(text: str, props: ET.Element | None, compat: bool) -> ET.Element:
    text = _ILLEGAL.sub("", text)
    out = ET.Element(W + "r")
    if props is not None:
        out.append(copy.deepcopy(props))
    t = ET.SubElement(out, W + "t")
    if text != (text.strip(" ") if compat else text.strip()):
        t.set(SPACE, "preserve")
    t.text = text
    return out


def parse_props(xml: str | None) -> ET.Element | None:
    try:
        return ET.fromstring(xml) if xml else None
    except ET.ParseError:
        return None


def only_formula(text: str) -> tuple[str, str | None] | None:
    """The formula and tag of a text that is nothing else."""
    m = _ONLY.match(text.strip())
    if not m or "$" in (m[1][2:-2] if m[1].startswith("$$") else m[1][1:-1]):
        return None
    return m[1], m[2].strip() if m[2] else None


def rebuild_paragraph(para: ET.Element, text: str, parts: Sequence[tuple[bool, str, str | None]], base: str | None, compat: bool) -> None:
    """Puts the text into the paragraph. ``parts``: the text in order as (whether it is a formula, text, properties); ``base``: properties of the baseline.

    What holds no text that was read stays where it is, and runs of text with a picture keep the picture. ``compat``: only paragraph properties, bookmarks,
    pictures without text and alternate content are kept, after the text.
    """
    runs = [x for x in para if x.tag == W + "r"]
    tabs = [copy.deepcopy(x) for x in runs if x.find(W + "tab") is not None and x.find(W + "t") is None]
    new: list[ET.Element] = []
    alone = only_formula(text) if tabs else None
    if alone:
        inner, tag = alone[0].strip("$").strip(), alone[1]
        if number := _NUMBER.search(inner):
            tag, inner = f"({number[1]})", inner[:number.start()].rstrip()
        new += [tabs[0], to_omml(inner, compat=compat)] + tabs[1:2] * bool(tag) + ([text_run(tag, parse_props(base), compat)] if tag else [])
    else:
        new += [to_omml(x.strip("$").strip(), compat=compat) if formula else text_run(x, parse_props(props), compat) for formula, x, props in parts]
    first, kept, last, place = [], [], [], None
    for child in list(para):
        name = local(child.tag)
        picture = child.tag == W + "r" and any(x.tag in PICTURES for x in child)
        if child.tag == W + "pPr":
            first += [child] * (not first)
        elif compat:
            if name in ("bookmarkStart", "bookmarkEnd", "AlternateContent") or picture and child.find(W + "t") is None:
                last.append(child)
        elif name in FORMULAS or child.tag == W + "r" and (child.find(W + "t") is not None or any(local(x.tag) in FORMULAS for x in child) or alone and child.find(W + "tab") is not None):
            place = len(kept) if place is None else place
            if picture and _without_text(child):
                kept.append(child)
        else:
            kept.append(child)
    place = len(kept) if place is None else place
    para[:] = first + kept[:place] + new + kept[place:] + last


def _without_text(run: ET.Element) -> bool:
    """Takes out of a run what was read as text, formulas of objects, too; whether a picture is left."""
    for x in [*run.findall(W + "object"), run]:
        for y in [y for y in x if local(y.tag) in FORMULAS or local(y.tag) == "t" and x is run or y.tag == W + "object" and not len(y)]:
            x.remove(y)
    return any(x.tag in PICTURES for x in run)


class Span(NamedTuple):
    """An outermost paragraph of a part: where its bytes are, the ids of it and of the paragraphs in it, and its XML with what its prefixes stand for."""

    begin: int
    end: int
    para_ids: list[str]
    xml: str
    spaces: list[tuple[str, str]]


_OPEN = re.compile(rb"""<(?:[^>"']|"[^"]*"|'[^']*')*>""")
_PREFIX = re.compile(r"[<\s/]([\w.-]+):")
_ENCODING = re.compile(rb"""^<\?xml[^>]*?encoding\s*=\s*["']([\w.-]+)["'][^>]*\?>""")


def as_utf8(xml: bytes) -> bytes:
    """The part in UTF-8: spans are of its bytes."""
    for mark, name in ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if xml.startswith(mark):
            text = xml.decode(name)
            return re.sub(r"^<\?xml.*?\?>", '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', text, flags=re.S).encode()
    found = _ENCODING.match(xml)
    if found and found[1].lower() not in (b"utf-8", b"us-ascii"):
        return b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + xml[found.end():].decode(found[1].decode()).encode()
    return xml


def spans(xml: bytes, *, compat: bool = False) -> list[Span]:
    """The outermost paragraphs of a part in UTF-8, in order. Names are told by what their prefixes stand for there."""
    parser, found, scopes, inside, number = expat.ParserCreate(), [], [{}], 0, 0
    begin, ids, spaces = 0, [], {}

    def named(name: str) -> str:
        prefix, _, rest = name.rpartition(":")
        return "{" + scopes[-1].get(prefix, "") + "}" + rest

    def opened(name: str, attributes: dict[str, str]) -> None:
        nonlocal inside, number, begin, ids, spaces
        own = {key[6:]: uri for key, uri in attributes.items() if key == "xmlns" or key.startswith("xmlns:")}
        outer = scopes[-1]
        scopes.append({**outer, **own} if own else outer)
        if named(name) == W + "p":
            if not inside:
                begin, ids, spaces = parser.CurrentByteIndex, [], outer
            given = next((x for key, x in attributes.items() if ":" in key and named(key) == W14 + "paraId"), "")
            ids.append(given or ("unknown" if compat else f"{number:08X}"))
            number += 1
            inside += 1

    def closed(name: str) -> None:
        nonlocal inside
        if named(name) == W + "p":
            inside -= 1
            if not inside:
                tag = _OPEN.match(xml, begin)
                end = tag.end() if tag[0].endswith(b"/>") else xml.index(b">", parser.CurrentByteIndex) + 1
                text = xml[begin:end].decode()
                used = {*_PREFIX.findall(text), ""}
                found.append(Span(begin, end, ids, text, [(k, v) for k, v in spaces.items() if k in used]))
        scopes.pop()

    parser.StartElementHandler, parser.EndElementHandler = opened, closed
    parser.Parse(xml, True)
    return found


def rebuild_span(xml: str, spaces: Sequence[tuple[str, str]], edits: Mapping[int, tuple[str, Sequence[tuple[bool, str, str | None]], str | None]], *, compat: bool = False) -> str:
    """A paragraph's XML with edits: of it (0) and of the paragraphs in it, by number, as (text, parts, properties of the baseline)."""
    declared = "".join(f' xmlns{":" if prefix else ""}{prefix}="{uri}"' for prefix, uri in spaces)
    for prefix, uri in spaces:
        if prefix and not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    outer = ET.fromstring(f"<x{declared}>{xml}</x>")[0]
    for number, para in enumerate(list(outer.iter(W + "p"))):
        if number in edits:
            rebuild_paragraph(para, *edits[number], compat)
    outer.tail = None
    head, end = ET.tostring(outer, encoding="unicode").split(">", 1)
    for prefix, uri in spaces:  # what is declared around the paragraph need not be in it
        head = head.replace(f' xmlns:{prefix}="{uri}"', "")
    return head + ">" + end


def spliced(xml: bytes, changed: Sequence[tuple[int, int, str]]) -> bytes:
    """The part with other text in place of some of its bytes."""
    out, at = [], 0
    for begin, end, text in changed:
        out += [xml[at:begin], text.encode()]
        at = end
    return b"".join([*out, xml[at:]])
