import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking, search, structured, windows
from lectern.sources import archive


def zipped(members):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as out:
        for name, content in members.items():
            out.writestr(name, content)
    return data.getvalue()


REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
CELL = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
DOCX = zipped({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr>{CELL.format('a')}{CELL.format('b')}</w:tr></w:tbl></w:body></w:document>"})


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("archive")
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    files = {
        "Fall 2029/C1 - One/lectures/a.txt": b"# Head\none\ntwo\n",
        "Fall 2029/C1 - One/lectures/B.txt": b"# Head\none\ntwo\n",
        "Fall 2029/C1 - One/code/n.ipynb": json.dumps({"cells": [{"cell_type": "code", "source": ["x = 1\n", "y"]}, {"cell_type": "markdown", "source": []}]}).encode(),
        "Program-wide/data/t.csv": b"Date,Price (USD)\n2026-01-01,10\n\n2026-01-02,20\n",
        "Program-wide/resources/z.zip": zipped({"inner.zip": zipped({"notes.txt": "deep", "d.docx": DOCX, "p.pdf": b"%PDF\xff"}), "../escape.txt": "no", "safe.txt": "yes", "__MACOSX/x.txt": "no", ".hidden.txt": "no"}),
        "Program-wide/resources/broken.zip": b"not a zip",
        "Program-wide/resources/d.docx": DOCX,
        "Program-wide/resources/s.xlsx": zipped({
            "xl/workbook.xml": f'<workbook {s} {REL}><sheets><sheet name="S" r:id="r7"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r7" Type="x/worksheet" Target="worksheets/other.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row r="1"><c r="A1"><v>9</v></c></row></sheetData></worksheet>',
            "xl/worksheets/other.xml": f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Value</t></is></c><c r="C1"><f>1+2</f><v>3</v></c></row>'
            '<row r="2"><c r="A2"><v>4.5</v></c><c r="C2"><f>A2</f></c></row></sheetData></worksheet>',
        }),
        "Program-wide/x.unknown": b"?",
        ".git/config": b"hidden",
    }
    for name, content in files.items():
        path = base / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_bytes(content)
    return str(base)


def test_inventory(spark, root):
    rows = {r.source_path: r for r in archive.inventory(archive.files(spark, root)).collect()}
    assert len(rows) == 9 and not any(p.startswith(".git") for p in rows)
    assert rows["Fall 2029/C1 - One/lectures/B.txt"].duplicate_of == "Fall 2029/C1 - One/lectures/a.txt"
    assert rows["Fall 2029/C1 - One/lectures/a.txt"].duplicate_of is None
    assert rows["Program-wide/x.unknown"].review_reasons == ["unsupported_extension"]


def test_extracted(spark, root):
    rows = archive.extracted(archive.files(spark, root)).collect()
    at = {(r.path.split("/")[-1], r.locator_value): r for r in rows}
    assert at["a.txt", "1-3"].text == "# Head\none\ntwo"
    assert at["n.ipynb", "1"].text == "x = 1\ny"
    assert at["z.zip", "inner.zip!notes.txt"].text == "deep" and at["z.zip", "inner.zip!d.docx#1"].text == "Hello\na\tb"
    assert at["z.zip", "inner.zip!p.pdf"].record_type == "unsupported" and at["z.zip", ""].record_type == "catalog" and "safe.txt\t3" in at["z.zip", ""].text
    assert not any("MACOSX" in v or "hidden" in v for f, v in at if f == "z.zip")
    assert at["z.zip", "../escape.txt"].record_type == "error"
    assert at["broken.zip", ""].record_type == "error"
    assert at["d.docx", "1"].text == "Hello\na\tb" and at["s.xlsx", "S!A1:C2"].text == "Value\t\t3\n4.5"
    assert "Price (USD)" in at["t.csv", ""].text and at["x.unknown", ""].record_type == "unsupported"


def test_safe_members():
    info = zipfile.ZipInfo("a.txt")
    info.file_size, info.compress_size = 30 * 2**20, 30 * 2**20
    assert not archive.safe_member(info)
    info.file_size, info.compress_size = 100_000, 1
    assert not archive.safe_member(info)
    info.file_size, info.compress_size = 100, 50
    assert archive.safe_member(info)


@pytest.mark.parametrize("name", ["a\\b.txt", "c:d.txt", "a\x01.txt", "/a.txt", "a/../b.txt", ""])
def test_unsafe_names(name):
    info = zipfile.ZipInfo("x")
    info.filename = name
    assert archive.member_problem(info) == "unsafe name"


def test_member_bytes_and_a_name_twice():
    data = zipped({"in.zip": zipped({"a/b.txt": "x"})})
    assert archive.member_bytes(data, ["in.zip", "a/b.txt"]) == b"x"
    for chain in ([], ["none.txt"], ["in.zip", "a", "b", "c"]):
        with pytest.raises(ValueError):
            archive.member_bytes(data, chain)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as twice:
        twice.writestr("a.txt", "1"), twice.writestr("a.txt", "2")
    assert [r[4] for r in archive.zip_members(out.getvalue()) if r[0] == "error"] == ["a name twice"] * 2


def test_slides_in_the_order_of_the_presentation():
    p, a = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"', 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    text = "<a:p><a:r><a:t>{}</a:t></a:r></a:p>"
    cell = f"<a:tc>{text}</a:tc>"
    data = zipped({
        "ppt/presentation.xml": f'<p:presentation {p} {REL}><p:sldIdLst><p:sldId r:id="b"/><p:sldId r:id="a"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": '<R><R Id="a" Type="x/slide" Target="slides/slide1.xml"/><R Id="b" Type="x/slide" Target="/ppt/slides/slide2.xml"/></R>',
        "ppt/slides/slide1.xml": f"<p:sld {p} {a}>{text.format('one')}<a:tr>{cell.format('x')}{cell.format('y')}</a:tr></p:sld>",
        "ppt/slides/slide2.xml": f"<p:sld {p} {a}>{text.format('two')}</p:sld>",
        "ppt/slides/_rels/slide2.xml.rels": '<R><R Id="n" Type="x/notesSlide" Target="../notesSlides/notesSlide9.xml"/></R>',
        "ppt/notesSlides/notesSlide9.xml": f"<p:notes {p} {a}>{text.format('said')}</p:notes>",
    })
    assert [(r[2], r[3]) for r in archive.pptx_slides(data)] == [("1", "two\nsaid"), ("2", "one\nx\ty")]


def test_questions_to_files(spark, root):
    rows = archive.table_rows(archive.files(spark, root))
    assert {(r.path.split("/")[-1], r.sheet, r.rows, r.columns) for r in archive.sheets(rows).collect()} == {("t.csv", "Data", 4, 2), ("s.xlsx", "S", 2, 3)}
    csv = structured.answer(rows.filter("path like '%.csv'"), ["path"], "B", "A1:B9", where="A", kind="date", low="2026-01-02T00:00:00").first()
    assert (csv.label, csv.unit, csv.rows_scanned, csv.rows_matched, csv.rows_excluded, csv.numeric_values, csv["sum"], csv.formulas) == ("Price (USD)", "USD", 3, 1, 2, 1, 20.0, 0)
    book = structured.answer(rows.filter("path like '%.xlsx'"), ["path", "sheet"], "C", header=False).first()
    assert (book.label, book.rows_scanned, book.numeric_values, book["sum"], book.formulas, book.missing_caches) == ("C", 2, 1, 3.0, 2, 1)
    for wrong in ({"column": "F", "selected": "A1:B2"}, {"column": "A", "selected": "B2:A1"}, {"column": "A", "where": "A", "low": 3, "high": 2}):
        with pytest.raises(ValueError):
            structured.answer(rows, ["path"], **wrong)


def test_delimited_lines(spark):
    df = spark.createDataFrame([(1, '\ufeffa,"b, ""c""",\r\n\n,x'), (2, None), (3, "")], "k long, t string")
    got = [(r.k, r.row_number, r.cells) for r in structured.delimited_lines(df, ["k"], "t").collect()]
    assert got == [(1, 1, ["a", 'b, "c"', ""]), (1, 3, ["", "x"])]


def test_recognised_words_keep_their_order(spark):
    head = "level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext"
    lines = [f"5\t1\t1\t1\t{i // 5}\t{i % 5 + 1}\t{i}\t0\t9\t9\t90.5\tw{i}" for i in range(40)]
    df = spark.createDataFrame([("p", "\n".join([head, *lines, ""]))], "k string, t string").repartition(3)
    row = archive.recognised_words(df, "k", "t").first()
    assert [w.text for w in row.words] == [f"w{i}" for i in range(40)] and row.confidence == 90.5


def test_pages_and_recognition(spark):
    df = spark.createDataFrame([("d", "one\ftwo\f", 3), ("e", None, 1)], "k string, t string, n int")
    assert sorted((r.k, r.page_number, r.text) for r in archive.pages(df, "k", "t", "n").collect()) == [("d", 1, "one"), ("d", 2, "two"), ("d", 3, ""), ("e", 1, "")]
    info = spark.createDataFrame([("Title: x\nPages:   12 \n",), ("none",)], "i string")
    assert [r[0] for r in info.select(archive.page_count("i")).collect()] == [12, None]
    head = "level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext"
    tsv = spark.createDataFrame([(1, f"{head}\n5\t1\t1\t1\t1\t1\t10\t20\t30\t40\t92\tHello\n5\t1\t1\t1\t1\t2\t1\t2\t3\t4\t-1\t \n")], "k int, t string")
    got = archive.recognised_words(tsv, "k", "t").first()
    assert got.confidence == 92.0 and got.words[0].text == "Hello" and list(got.words[0].box) == [10, 20, 30, 40]


def test_line_blocks_carry_headings(spark):
    df = spark.createDataFrame([(1, "# A\nx\ny\nz\n## B\nw\n"), (2, ""), (3, None), (4, "\n\n")], "k int, t string")
    got = [(r.k, r.line_start, r.line_end, r.section_title) for r in archive.line_blocks(df, ["k"], "t", 2).orderBy("k", "line_start").collect()]
    assert got == [(1, 1, 2, "A"), (1, 3, 4, "A"), (1, 5, 6, "B")]


def test_chunks(spark):
    long = ("word " * 300 + ".\n\n") * 9
    df = spark.createDataFrame([(1, long), (2, "short"), (3, " "), (4, None), (5, "x" * 9000)], "k int, t string")
    rows = chunking.chunks(df, ["k"], "t").collect()
    by = {k: sorted((r.part_number, r.char_start, r.char_end, r.text) for r in rows if r.k == k) for k in range(1, 6)}
    assert by[2] == [(1, 0, 5, "short")] and not by[3] and not by[4]
    assert all(len(t) <= 3500 for parts in by.values() for *_, t in parts)
    assert "".join(sorted({t for *_, t in by[5]})) and by[5][0][2] == 3500 and by[5][1][1] == 3100
    ends = [e for _, _, e, _ in by[1]]
    assert ends == sorted(ends) and all(b[1] < a[2] for a, b in zip(by[1], by[1][1:]))


def test_token_windows(spark):
    df = spark.createDataFrame([(n, ["t"] * n) for n in (0, 1, 224, 225, 416, 417, 1000)], "k int, t array<string>")
    got = {}
    for r in chunking.token_windows(df, ["k"], F.col("t")).orderBy("k", "win_start").collect():
        got.setdefault(r.k, []).append((r.win_start, r.win_end))
    assert got[0] == [(0, 0)] and got[224] == [(0, 224)] and got[225] == [(0, 224), (192, 225)] and got[416] == [(0, 224), (192, 416)] and got[1000][-1][1] == 1000


def test_filters_bind_to_one_alias(spark):
    df = spark.createDataFrame(
        [("p", "d", "C1", "Fall", "lecture", "", "Fall/C1", "pdf", "not_reviewed"), ("q", "d", "C2", "Spring", "lecture", "", "Spring/C2", "pdf", "not_reviewed")],
        "path string, document_id string, course string, term string, content_type string, lecturer string, folder string, file_type string, review string",
    )
    assert search.matching_sources(df, {"course": "c1", "term": "FALL"}).count() == 1
    assert search.matching_sources(df, {"course": "c1", "term": "Spring"}).count() == 0
    assert search.matching_sources(df, {"folder": "spring", "course": []}).count() == 1
    for wrong in ({"colour": "x"}, {"course": [1]}):
        with pytest.raises(ValueError):
            search.matching_sources(df, wrong)
    with pytest.raises(ValueError):
        search.pinned(df, [])


def test_diversified_equals_the_sequential_rule(spark):
    import random

    rng = random.Random(3)
    hits = [(i, f"d{rng.randrange(4)}", "t", str(rng.randrange(12)), rng.choice([5, 300]), round(rng.random(), 2)) for i in range(60)]
    size = {d: s for _, d, _, _, s, _ in hits}
    hits = [(i, d, t, v, size[d], x) for i, d, t, v, _, x in hits]
    df = spark.createDataFrame(hits, "id int, doc string, lt string, lv string, size int, score double")
    k = 7
    got = [r.id for r in search.diversified(df, "id", "doc", ["lt", "lv"], "size", k).collect()]
    seen, count, out, late = set(), {}, [], []
    for i, d, t, v, s, x in sorted(hits, key=lambda h: (-h[5], h[0])):
        if (d, t, v) in seen or len(out) == k:
            continue
        if count.get(d, 0) >= (1 if s > 200 else max(2, (k + 2) // 3)):
            late.append((i, (d, t, v)))
            continue
        seen.add((d, t, v)), out.append(i)
        count[d] = count.get(d, 0) + 1
    for i, place in late:
        if place not in seen and len(out) < k:
            seen.add(place), out.append(i)
    assert got == out


def test_bm25_edges(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "beta")], "id int, text string")
    got = {r.id: r.score for r in search.bm25(df, "id", {"q": ["alpha", "alpha", "nowhere"]}, {"text": 1.0}).collect()}
    assert set(got) == {1}
    assert search.bm25(df, "id", {}, {"text": 1.0}).count() == 0
    assert search.bm25(df.limit(0), "id", {"q": ["alpha"]}, {"text": 1.0}).count() == 0


def test_latest_and_runs(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "del"), ("b", 1, "x"), ("b", 2, "y")], "k string, rev int, v string")
    assert [(r.k, r.rev) for r in windows.latest(df, ["k"], ["rev"], F.col("v") == "del").collect()] == [("b", 2)]
    states = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x"), (5, None)], "t int, s string").withColumn("k", F.lit(1))
    assert sorted((r.first, r.last, r.s) for r in windows.runs(states, ["k"], ["t"], "s").collect()) == [(1, 2, None), (3, 4, "x"), (5, 5, None)]
