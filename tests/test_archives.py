import io
import zipfile

from blockloom.sources import archives


def packed(spark, tmp_path, name, files):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for member, text in files.items():
            z.writestr(member, text)
    (tmp_path / name).write_bytes(data.getvalue())
    return archives.archives(spark, str(tmp_path), "*." + name.rsplit(".", 1)[1])


def test_project(spark, tmp_path):
    files = {"a/other.tex": "\\documentclass{x}", "a/main.tex": "\\documentclass{article}A \\input{sec/one} B \\include{missing} C", "__MACOSX/x.tex": "", "sec/one.tex": "1 \\input{./two.tex} 1", "two.tex": "2", "big.png": "x" * 100}
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    rows = packed(spark, tmp_path, "p.zip", files)
    found = archives.members(rows, most_bytes=90)
    assert sorted(r.member for r in found.collect()) == ["a/main.tex", "a/other.tex", "big.png", "sec/one.tex", "two.tex"]
    assert [r.data for r in found.where("member = 'big.png'").collect()] == [None]
    assert archives.main_files(found).first().member == "a/main.tex"
    assert archives.with_inputs(found).first().text == "\\documentclass{article}A 1 2 1 B  C"


def test_docx(spark, tmp_path):
    xml = '<w:document><w:p w:x="1"><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Ti</w:t></w:r><w:r><w:t xml:space="preserve">tle &amp; x</w:t></w:r></w:p><w:p><w:r><w:t>2.1 Methods</w:t></w:r></w:p><w:p><w:pPr><w:numPr></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:p><w:r><w:t>plain text</w:t></w:r></w:p></w:document>'
    rows = archives.docx_paragraphs(packed(spark, tmp_path, "d.docx", {"word/document.xml": xml}))
    got = rows.withColumn("kind", archives.docx_kind(rows.text, rows.style, rows.bold, rows.numbered)).orderBy("pos").collect()
    assert [(r.text, r.kind) for r in got] == [("Title & x", "heading"), ("2.1 Methods", "heading"), ("item", "list"), ("plain text", "paragraph")]


def test_epub(spark, tmp_path):
    opf = '<package><dc:title>T</dc:title><dc:language></dc:language><manifest><item id="b" href="two.xhtml"/><item href="one.xhtml" id="a"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>'
    rows = packed(spark, tmp_path, "e.epub", {"OEBPS/x.opf": opf, "OEBPS/one.xhtml": "<h1>One</h1><p>text</p>", "OEBPS/two.xhtml": "<p>more<img src='x'></p>"})
    assert [(r.title, r.text) for r in archives.epub_chapters(rows).orderBy("pos").collect()] == [("One", "One text"), (None, "more")]
    assert sorted(r.issue for r in archives.epub_issues(rows).collect()) == ["chapter_without_title", "image_without_text", "no_author", "no_language"]


def test_packing_and_reading_once(spark, monkeypatch):
    """no pandas frame for each archive, and archives of books are unzipped once."""
    parts = spark.createDataFrame([(1, "b", "x"), (1, "a", "é"), (2, "a", None), (None, "a", "y"), (2, None, "z")], "path int, member string, data string")
    made = archives.packed(parts)
    assert "InPandas" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.path, r.member, bytes(r.data)) for r in archives.members(made).collect()) == [("1", "a", "é".encode()), ("1", "b", b"x"), ("2", "a", b"")]
    calls, members = [], archives.members
    monkeypatch.setattr(archives, "members", lambda rows: calls.append(1) or members(rows))
    found = archives.epub_chapters(made)
    assert len(calls) == 1 and "InArrow" not in found._jdf.queryExecution().optimizedPlan().toString() and not found.count()
