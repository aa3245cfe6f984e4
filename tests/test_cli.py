"""The three commands, one after another, on one file."""

import json

from pagewright.__main__ import main
from pagewright.functions.omml import W
from pagewright.functions.wordml import read_runs, unzip
from pagewright.plans import samples


def test_commands(spark, tmp_path):
    source = tmp_path / "in.docx"
    source.write_bytes(samples.package(samples.paragraph_xml(10, [("<w:b/>", "Bold "), ("", "plain"), ("", " text")])))
    assert main(["extract", str(source), f"file://{tmp_path}/out"]) == 0
    folder = next((tmp_path / "out").iterdir())
    chunk = folder / "chunk_0.md"
    assert (folder / "origin_chunks" / "chunk_0.md").read_text() == chunk.read_text()
    assert chunk.read_text() == "[0000000A] ‹F1:b›Bold ‹/›plain text"
    assert main(["verify", str(folder), str(folder)]) == 0
    edited = tmp_path / "edited"
    edited.mkdir()
    (edited / "chunk_0.md").write_text(chunk.read_text().replace("plain", "other"))
    (tmp_path / "wrong").mkdir()
    (tmp_path / "wrong" / "chunk_0.md").write_text("[0000000B] x")
    assert main(["verify", str(tmp_path / "wrong"), str(folder)]) == 1
    assert main(["rebuild", str(source), str(edited), str(folder / "format_registry.json"), f"file://{tmp_path}/back"]) == 0
    runs = read_runs(dict(unzip((tmp_path / "back" / "restored.docx").read_bytes()))["word/document.xml"])
    assert [(r.text, r.fmt["bold"]) for r in runs] == [("Bold ", True), ("other text", False)]


def test_old_registries_missing_folders_and_files_that_are_no_text(spark, tmp_path, capsys):
    source = tmp_path / "in.docx"
    link = "<w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>"
    source.write_bytes(samples.package(samples.paragraph_xml(10, [("<w:b/>", "Bold "), ("", "plain")]).replace("</w:p>", link)))
    folder = tmp_path / "chunks"
    assert main(["verify", str(folder), str(tmp_path / "none")]) == 1
    assert capsys.readouterr().out.count("DIR_MISSING") == 2
    folder.mkdir()
    (folder / "chunk_0.md").write_text("[0000000A] a ‹F1:i›b‹/›")
    registry = tmp_path / "old.json"
    registry.write_text(json.dumps({"baseline": "F0", "categories": {"F0": {"rpr_xml": f'<w:rPr xmlns:w="{W[1:-1]}"><w:i/></w:rPr>'}, "F1": {"rpr_xml": f'<w:rPr xmlns:w="{W[1:-1]}"><w:b/></w:rPr>'}}}))
    for options, links in (([], 1), (["--compat"], 0)):
        assert main([*options, "rebuild", str(source), str(folder), str(registry), f"file://{tmp_path}/back"]) == 0
        xml = dict(unzip((tmp_path / "back" / "restored.docx").read_bytes()))["word/document.xml"]
        assert [(r.text, r.fmt["italic"], r.fmt["bold"]) for r in read_runs(xml)] == [("a ", True, False), ("b", False, True)]
        assert xml.count(b"<w:hyperlink") == links
    assert main(["rebuild", str(source), str(folder), str(tmp_path / "no.json"), f"file://{tmp_path}/back"]) == 0
    assert "no registry" in capsys.readouterr().out
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "chunk_0.md").write_bytes(b"[0000000A] \xff")
    assert main(["verify", str(tmp_path / "bad"), str(folder)]) == 1
    out = capsys.readouterr().out
    assert "READ_FAILED" in out and "LINE_COUNT" in out and "ONLY_IN" not in out


def test_no_package_is_told(spark, tmp_path, capsys):
    (tmp_path / "a.DOCX").write_bytes(b"x")
    for path in (tmp_path / "a.DOCX", tmp_path / "none.docx"):
        assert main(["extract", str(path), f"file://{tmp_path}/out"]) == 1
        assert main(["rebuild", str(path), str(tmp_path), str(tmp_path / "r.json"), f"file://{tmp_path}/out"]) == 1
    assert capsys.readouterr().out.count("no package") == 4


def test_a_registry_of_another_document_is_told(spark, tmp_path, capsys):
    source = tmp_path / "in.docx"
    source.write_bytes(samples.package(samples.paragraph_xml(10, [("", "plain")])))
    (tmp_path / "r.json").write_text(json.dumps({"doc_hash": "other", "paragraphs": {}}))
    (tmp_path / "chunk_0.md").write_text("[0000000A] new")
    assert main(["rebuild", str(source), str(tmp_path), str(tmp_path / "r.json"), f"file://{tmp_path}/back"]) == 0
    assert "another document, other" in capsys.readouterr().out
