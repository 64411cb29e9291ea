"""Files of an archive as tables: inventory, and the texts of each kind of file with their locators.

A file's bytes come from Spark's ``binaryFile`` source, so reading and hashing are spread over tasks. Text formats are
taken apart by expressions; packed formats (ZIP and the Office formats, which are ZIPs) by a small helper per file, under
fixed bounds. A file that can't be read gives an ``error`` row instead of failing the job.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import paths
from lectern.operators.structured import column_index, column_letter

#: Bounds of nested archives and of workbooks.
MOST_DEPTH, MOST_MEMBERS, MEMBER_BYTES, ALL_BYTES, MOST_RATIO = 2, 1000, 25 * 2**20, 100 * 2**20, 200
BOOK_MEMBERS, BOOK_BYTES, BOOK_MEMBER_BYTES, BOOK_RATIO = 10_000, 256 * 2**20, 64 * 2**20, 500
MOST_RECORDS, LISTED = 5000, 500
LINES, SLICE, ROWS, ROW_CHARS = 180, 3500, 40, 12_000

RECORD = "record_type string, locator_type string, locator_value string, text string, error string"


def files(spark: SparkSession, root: str) -> DataFrame:
    """``path`` below ``root``, ``size_bytes``, ``modified_at`` and ``content`` of every file that isn't ignored."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    out = read.select(base.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    return out.filter(~paths.ignored(F.col("path")))


def inventory(found: DataFrame) -> DataFrame:
    """The manifest: identity by content, context by path, and the first path (letter case aside) of equal files."""
    path = F.col("source_path")
    rows = found.select(F.col("path").alias("source_path"), "size_bytes", "modified_at", F.sha2("content", 256).alias("content_hash"))
    rows = rows.withColumn("document_id", F.concat(F.lit("sha256:"), F.col("content_hash"))).withColumn("route", paths.route(path)).withColumns(paths.context(path))
    rows = rows.withColumn("review_reasons", paths.review_reasons(F.col("route"), F.col("size_bytes"), F.col("access_review")))
    return with_canonical(rows)


def with_canonical(rows: DataFrame) -> DataFrame:
    """``source_paths`` (all paths of equal content, in order without letter case) and ``duplicate_of`` (the first of them,
    for the others)."""
    entry = F.struct(F.lower("source_path").alias("k"), F.col("source_path").alias("p"))
    same = rows.groupBy("content_hash").agg(F.array_sort(F.collect_set(entry)).alias("_s"))
    all_paths = F.transform("_s", lambda s: s["p"])
    joined = rows.join(same.select("content_hash", all_paths.alias("source_paths")), "content_hash")
    first = F.get("source_paths", F.lit(0))
    return joined.withColumn("duplicate_of", F.when(F.col("source_path") != first, first))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; blank lines are skipped and a malformed one ends the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def text_lines(found: DataFrame, lines: int = LINES) -> DataFrame:
    """Blocks of ``lines`` lines of text files: ``path``, ``line_start``, ``line_end``, ``section_title``, ``text``."""
    return line_blocks(found.select("path", F.decode("content", "UTF-8").alias("text")), ["path"], "text", lines)


def line_blocks(texts: DataFrame, key: list[str], text: str, lines: int = LINES) -> DataFrame:
    """Blocks of ``lines`` lines, with the last heading (a line that begins with ``#``) up to the end of the block.

    A text is split into blocks by one expression, so its lines never become rows of their own.
    """
    split = F.split(F.regexp_replace(F.regexp_replace(F.col(text), r"\r\n?", "\n"), r"\n\z", ""), "\n")
    starts = F.sequence(F.lit(0), F.size("_l") - 1, F.lit(lines))
    blocks = texts.filter(F.length(text) > 0).select(*key, split.alias("_l")).select(*key, "_l", F.explode(starts).alias("_s"))
    own = F.slice("_l", F.col("_s") + 1, F.lit(lines))
    heading = F.try_element_at(F.filter(own, lambda x: F.ltrim(x).startswith("#")), F.lit(-1))
    cut = blocks.select(
        *key,
        (F.col("_s") + 1).alias("line_start"),
        F.least(F.col("_s") + lines, F.size("_l")).alias("line_end"),
        F.trim(F.regexp_replace(F.trim(heading), "^#+", "")).alias("_h"),
        F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+\z", "").alias("text"),
    ).filter("text <> ''")
    so_far = Window.partitionBy(*key).orderBy("line_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.select(*key, "line_start", "line_end", F.last("_h", ignorenulls=True).over(so_far).alias("section_title"), "text")


def notebook_cells(found: DataFrame) -> DataFrame:
    """The cells with text of notebooks: ``path``, ``cell_number``, ``cell_type``, ``text``."""
    either = F.from_json(F.decode("content", "UTF-8"), "cells array<struct<cell_type: string, source: array<string>>>")
    plain = F.from_json(F.decode("content", "UTF-8"), "cells array<struct<cell_type: string, source: string>>")
    cells = found.select("path", either.alias("a"), plain.alias("b"))
    each = cells.select("path", F.posexplode(F.arrays_zip(F.col("a.cells").alias("a"), F.col("b.cells").alias("b"))).alias("n", "c"))
    text = F.coalesce(F.array_join("c.a.source", ""), F.col("c.b.source"))
    out = each.select("path", (F.col("n") + 1).alias("cell_number"), F.coalesce("c.a.cell_type", "c.b.cell_type", F.lit("unknown")).alias("cell_type"), F.trim(text).alias("text"))
    return out.filter("text <> ''")


def pages(texts: DataFrame, key: str, text: str, page_count: str) -> DataFrame:
    """Pages of a text divided by form feeds, up to the page count; pages without text are there with an empty one."""
    number = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col(page_count)))).alias("page_number")
    split = texts.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "\f").alias("_p"), page_count).select(key, "_p", number)
    return split.select(key, "page_number", F.trim(F.coalesce(F.get("_p", F.col("page_number") - 1), F.lit(""))).alias("text"))


def page_count(info: str):
    """The page count in a tool's report; null if there is none."""
    return F.regexp_extract(info, r"(?m)^Pages:\s+(\d+)\s*$", 1).try_cast("int")


def needs_recognition(text: str, least: int = 24):
    """Whether a page has too little text, so that its image must be read."""
    return F.length(F.regexp_replace(text, r"\s+", "")) < least


def recognised_words(tables: DataFrame, key: str, tsv: str) -> DataFrame:
    """Words of a recogniser's tab-separated report: ``key``, ``words`` (text, confidence, box) and mean ``confidence``."""
    lines = F.slice(F.split(tsv, "\n"), 2, F.greatest(F.lit(0), F.size(F.split(tsv, "\n")) - 1))
    rows = tables.select(key, F.posexplode(lines).alias("n", "line")).select(key, "n", F.split("line", "\t").alias("c")).filter((F.size("c") >= 12) & (F.trim(F.get("c", F.lit(11))) != ""))
    box = F.array(*[F.get("c", F.lit(i)).try_cast("int") for i in (6, 7, 8, 9)])
    word = rows.select(key, F.struct("n", F.get("c", F.lit(11)).alias("text"), F.get("c", F.lit(10)).try_cast("double").alias("confidence"), box.alias("box")).alias("w"))
    word = word.filter("w.confidence >= 0")
    # The place in the report orders the words, whatever way they come together. A report is one page.
    gathered = word.groupBy(key).agg(F.array_sort(F.collect_list("w")).alias("words"), F.bround(F.avg("w.confidence"), 1).alias("confidence"))
    return gathered.withColumn("words", F.transform("words", lambda w: F.struct(w["text"], w["confidence"], w["box"])))


def dataset_catalog(found: DataFrame) -> DataFrame:
    """Rows with the header, first 100 columns and first 10 rows of delimited files."""
    comma = F.when(paths.suffix(F.col("path")) == ".tsv", F.lit("\t")).otherwise(F.lit(","))

    @F.pandas_udf("struct<row_count: long, columns: array<string>, sample: array<array<string>>>")
    def read(contents: pd.Series, separators: pd.Series) -> pd.DataFrame:
        import csv

        out = []
        for content, separator in zip(contents, separators):
            rows = csv.reader(io.StringIO(content.decode("utf-8", "replace"), newline=""), delimiter=separator)
            head = next(rows, [])[:100]
            count, sample = int(bool(head)), []
            for row in rows:
                count += 1
                if len(sample) < 10:
                    sample.append(row[:100])
            out.append({"row_count": count, "columns": head, "sample": sample})
        return pd.DataFrame(out, columns=["row_count", "columns", "sample"])

    return found.select("path", read("content", comma).alias("r")).select("path", "r.*")


# Packed files


def member_problem(info: zipfile.ZipInfo) -> str | None:
    """Why a member is refused: a name that could lead out of its folder or means different places on different systems, a
    link, encryption, or a size beyond the bounds. None if it is safe."""
    name = info.filename
    if not name or name.startswith("/") or ".." in name.split("/") or re.search(r"[\\:\x00-\x1f]", name):
        return "unsafe name"
    if info.flag_bits & 1 or (info.external_attr >> 16) & 0o170000 == 0o120000:
        return "link or encrypted"
    if info.file_size > MEMBER_BYTES or info.file_size > max(1, info.compress_size) * MOST_RATIO:
        return "too large or too densely packed"
    return None


def safe_member(info: zipfile.ZipInfo) -> bool:
    return member_problem(info) is None


def member_bytes(content: bytes, chain: list[str]) -> bytes:
    """The bytes of the member that ``chain`` names, through archives within archives. A name that is missing, ambiguous or
    unsafe is an error."""
    if not 1 <= len(chain) <= MOST_DEPTH + 1:
        raise ValueError("a chain names one to three members")
    for name in chain:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            infos = [i for i in archive.infolist() if i.filename == name]
            if len(infos) != 1:
                raise ValueError("missing or ambiguous member")
            if problem := member_problem(infos[0]):
                raise ValueError(problem)
            content = archive.read(infos[0])
    return content


def safe_workbook(archive: zipfile.ZipFile) -> None:
    members = archive.infolist()
    if len(members) > BOOK_MEMBERS or sum(m.file_size for m in members) > BOOK_BYTES:
        raise ValueError("the workbook expands beyond its bounds")
    if any(m.file_size > BOOK_MEMBER_BYTES or m.file_size > max(1, m.compress_size) * BOOK_RATIO for m in members):
        raise ValueError("a member of the workbook expands beyond its bounds")


def zip_members(content: bytes) -> Iterator[tuple]:
    """A catalog of the archive's first members, and each safe member's records by the extractor of its own kind, or what is
    wrong with it. Archives within are opened, two deep. Members, bytes and records are bounded for the whole archive."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        listed = [f"{i.filename}\t{i.file_size}" for i in archive.infolist()[:LISTED]]
    yield ("catalog", "document", "", "\n".join(listed), None)
    left = {"members": MOST_MEMBERS, "bytes": ALL_BYTES, "records": MOST_RECORDS}

    def own_records(name: str, data: bytes, where: str, depth: int) -> Iterator[tuple]:
        kind = paths.route_of(name)
        if kind == "archive":
            yield from walk(data, where, depth + 1) if depth < MOST_DEPTH else [("error", "archive_member", where, "", "nested too deep")]
        elif kind in ("text", "markdown", "source_code", "dataset", "notebook"):
            yield ("text", "archive_member", where, data.decode("utf-8", "replace"), None)
        elif kind in EXTRACTORS:
            for record, _, value, text, error in EXTRACTORS[kind](data):
                yield (record, "archive_member", f"{where}#{value}" if value else where, text, error)
        else:
            yield ("unsupported", "archive_member", where, "", "no extractor for this kind of member")

    def walk(data: bytes, chain: str, depth: int) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            names = Counter(archive.namelist())
            for info in archive.infolist():
                folders = info.filename.split("/")
                if info.is_dir() or "__MACOSX" in folders or folders[-1].startswith("."):
                    continue
                where = f"{chain}!{info.filename}" if chain else info.filename
                left["members"] -= 1
                if left["members"] < 0 or left["records"] <= 0:
                    yield ("error", "archive_member", where, "", "too many members or records")
                    return
                problem = member_problem(info) or ("a name twice" if names[info.filename] > 1 else "too large in all" if info.file_size > left["bytes"] else None)
                if problem:
                    yield ("error", "archive_member", where, "", problem)
                    continue
                try:
                    own = archive.read(info)
                    left["bytes"] -= len(own)
                    for record in own_records(info.filename, own, where, depth):
                        left["records"] -= 1
                        yield record
                except Exception as problem:  # a broken member is a record
                    yield ("error", "archive_member", where, "", str(problem))

    yield from walk(content, "", 1)


_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def related(archive: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """What a part of an Office file refers to: for each relationship its kind and the part it leads to."""
    folder, _, name = part.rpartition("/")
    listed = f"{folder}/_rels/{name}.rels"
    if listed not in archive.namelist():
        return {}
    out = {}
    for link in ElementTree.fromstring(archive.read(listed)):
        target = link.get("Target", "")
        where = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        out[link.get("Id", "")] = (link.get("Type", "").rpartition("/")[2], where)
    return out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_blocks(content: bytes) -> Iterator[tuple]:
    """The paragraphs and table rows (cells by tabs) of a document, in slices of 3,500 characters."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        safe_workbook(archive)
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")

    def words(element) -> str:
        return "".join(t.text or "" for t in element.iter(f"{_W}t"))

    lines: list[str] = []
    for block in body if body is not None else ():
        if block.tag == f"{_W}tbl":
            lines += ["\t".join(" ".join(words(p) for p in cell.iter(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")) for row in block.iter(f"{_W}tr")]
        else:
            lines += [words(p) for p in block.iter(f"{_W}p")]
    text = "\n".join(x for x in lines if x.strip())
    for n, begin in enumerate(range(0, len(text), SLICE), 1):
        yield ("text", "docx_block", str(n), text[begin : begin + SLICE].strip(), None)


def pptx_slides(content: bytes) -> Iterator[tuple]:
    """The text of each slide with its table rows (cells by tabs) and speaker notes, in the order of the presentation; both
    are found by the file's relationships."""

    def lines(root) -> Iterator[str]:
        inside = {id(p) for row in root.iter(f"{_A}tr") for p in row.iter(f"{_A}p")}
        for element in root.iter():
            if element.tag == f"{_A}tr":
                yield "\t".join(" ".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in cell.iter(f"{_A}p")).strip() for cell in element.findall(f"{_A}tc"))
            elif element.tag == f"{_A}p" and id(element) not in inside:
                yield "".join(t.text or "" for t in element.iter(f"{_A}t"))

    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        safe_workbook(archive)
        links = related(archive, "ppt/presentation.xml")
        show = ElementTree.fromstring(archive.read("ppt/presentation.xml")) if links else ElementTree.Element("none")
        slides = [links[i.get(f"{_R}id")][1] for i in show.iter(f"{_P}sldId") if i.get(f"{_R}id") in links]
        for n, slide in enumerate(slides, 1):
            notes = [where for kind, where in related(archive, slide).values() if kind == "notesSlide"]
            text = [line for part in (slide, *notes) for line in lines(ElementTree.fromstring(archive.read(part))) if line.strip()]
            yield ("text", "pptx_slide", str(n), "\n".join(text).strip(), None)


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None], list[str | None]]]:
    """``(sheet, row number, cells, formulas)`` of a workbook, its sheets found by the file's relationships. A cell with a
    formula has its cached value, or null if none was stored; formulas are never evaluated."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        safe_workbook(archive)
        names = archive.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        links = related(archive, "xl/workbook.xml")
        for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            kind, part = links.get(sheet.get(f"{_R}id", ""), ("", ""))
            if kind != "worksheet" or part not in names:
                continue
            for row in ElementTree.fromstring(archive.read(part)).iter(f"{_S}row"):
                cells: list[str | None] = []
                formulas: list[str | None] = []
                for c in row.iter(f"{_S}c"):
                    letters = re.match(r"[A-Z]+", c.get("r", ""))
                    at = column_index(letters[0]) if letters else len(cells) + 1
                    cells += [None] * (at - len(cells))
                    formulas += [None] * (at - len(formulas))
                    value, inline, formula = c.find(f"{_S}v"), c.find(f"{_S}is"), c.find(f"{_S}f")
                    text = value.text if value is not None else "".join(t.text or "" for t in inline.iter(f"{_S}t")) if inline is not None else None
                    cells[at - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
                    formulas[at - 1] = None if formula is None else f"={formula.text or ''}"
                yield sheet.get("name", ""), int(row.get("r", 0)), cells, formulas


def delimited_rows(content: bytes, separator: str) -> Iterator[tuple[str, int, list[str | None], list[str | None]]]:
    """The records of delimited text as ``sheet_rows`` has those of a workbook; a quoted cell may hold line ends."""
    import csv

    for n, cells in enumerate(csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"), newline=""), delimiter=separator), 1):
        yield "Data", n, cells, [None] * len(cells)


def table_rows(found: DataFrame) -> DataFrame:
    """``path``, ``sheet``, ``row_number``, ``cells`` and ``formulas`` of every row of delimited files and workbooks: what
    ``operators.structured.answer`` asks. A file that can't be read gives no rows; ``extracted`` has its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "sheet", "row_number", "cells", "formulas"]
        for rows in batches:
            for path, way, content in zip(rows["path"], rows["route"], rows["content"]):
                held = []
                try:
                    read = sheet_rows(bytes(content)) if way == "spreadsheet" else delimited_rows(bytes(content), "\t" if path.lower().endswith(".tsv") else ",")
                    for row in read:
                        held.append((path, *row))
                        if len(held) == 10_000:
                            yield pd.DataFrame(held, columns=columns)
                            held = []
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                    held = []
                yield pd.DataFrame(held, columns=columns)

    tables = found.withColumn("route", paths.route(F.col("path"))).filter("route in ('spreadsheet', 'dataset')").select("path", "route", "content")
    return tables.mapInPandas(run, "path string, sheet string, row_number long, cells array<string>, formulas array<string>")


def sheets(rows: DataFrame) -> DataFrame:
    """The sheets of ``table_rows``: their last row and greatest width."""
    return rows.groupBy("path", "sheet").agg(F.max("row_number").alias("rows"), F.max(F.size("cells")).alias("columns"))


def spreadsheet_ranges(content: bytes) -> Iterator[tuple]:
    """Batches of rows as ``Sheet!A1:D40`` with the cells tab-separated: 40 rows, or fewer if they are long."""
    batch: list[tuple[int, str, int]] = []
    sheet = None

    def flush() -> Iterator[tuple]:
        if batch:
            last = column_letter(max(1, max(w for _, _, w in batch)))
            yield ("text", "spreadsheet_range", f"{sheet}!A{batch[0][0]}:{last}{batch[-1][0]}", "\n".join(t for _, t, _ in batch), None)
            batch.clear()

    for title, number, cells, _ in sheet_rows(content):
        if title != sheet:
            yield from flush()
            sheet = title
        while cells and not (cells[-1] or "").strip():
            cells.pop()
        if cells:
            batch.append((number, "\t".join(c or "" for c in cells), len(cells)))
        if len(batch) >= ROWS or sum(len(t) for _, t, _ in batch) >= ROW_CHARS:
            yield from flush()
    yield from flush()


def image_size(content: bytes) -> Iterator[tuple]:
    """Width and height of a PNG, GIF or JPEG image, from its header."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        size = int.from_bytes(content[16:20]), int.from_bytes(content[20:24])
    elif content[:3] == b"GIF":
        size = int.from_bytes(content[6:8], "little"), int.from_bytes(content[8:10], "little")
    elif content[:2] == b"\xff\xd8":
        at = 2
        while not (0xC0 <= content[at + 1] <= 0xCF and content[at + 1] not in (0xC4, 0xC8, 0xCC)):
            at += 2 + int.from_bytes(content[at + 2 : at + 4])
        size = int.from_bytes(content[at + 7 : at + 9]), int.from_bytes(content[at + 5 : at + 7])
    else:
        raise ValueError("not an image of a known kind")
    yield ("image", "image", "1", json.dumps({"width": size[0], "height": size[1]}), None)


EXTRACTORS: dict[str, Callable[[bytes], Iterator[tuple]]] = {
    "archive": zip_members,
    "docx": docx_blocks,
    "pptx": pptx_slides,
    "spreadsheet": spreadsheet_ranges,
    "image": image_size,
}


def extracted(found: DataFrame, extractors: dict[str, Callable[[bytes], Iterator[tuple]]] | None = None) -> DataFrame:
    """Records of all files, by their route: text and notebooks by expressions, packed files by ``extractors``, and an
    ``unsupported`` or ``error`` record for the others. External tools (for PDF or legacy Office) are added as extractors.
    """
    extractors = EXTRACTORS | (extractors or {})
    routed = found.withColumn("route", paths.route(F.col("path")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, way, content in zip(rows["path"], rows["route"], rows["content"]):
                try:
                    out = list(extractors[way](bytes(content)))
                except Exception as problem:  # a broken file is a record, not a failed job
                    out = [("error", "document", "", "", str(problem))]
                yield pd.DataFrame([(path, *r) for r in out], columns=["path", "record_type", "locator_type", "locator_value", "text", "error"])

    packed = routed.filter(F.col("route").isin(list(extractors))).select("path", "route", "content").mapInPandas(run, "path string, " + RECORD)
    plain = text_lines(routed.filter(F.col("route").isin("text", "markdown", "source_code")))
    plain = plain.select("path", F.lit("text").alias("record_type"), F.lit("line_range").alias("locator_type"), F.concat_ws("-", "line_start", "line_end").alias("locator_value"), "text")
    cells = notebook_cells(routed.filter("route = 'notebook'"))
    cells = cells.select("path", F.lit("text").alias("record_type"), F.lit("notebook_cell").alias("locator_type"), F.col("cell_number").cast("string").alias("locator_value"), "text")
    tables = dataset_catalog(routed.filter("route = 'dataset'"))
    summary = F.concat(F.lit("Rows with header: "), F.col("row_count"), F.lit("\nColumns: "), F.array_join("columns", ", "))
    tables = tables.select("path", F.lit("dataset").alias("record_type"), F.lit("document").alias("locator_type"), F.lit("").alias("locator_value"), summary.alias("text"))
    known = [*extractors, "text", "markdown", "source_code", "notebook", "dataset"]
    rest = routed.filter(~F.col("route").isin(known)).select("path", F.lit("unsupported").alias("record_type"), F.lit("document").alias("locator_type"), F.lit("").alias("locator_value"), F.lit("").alias("text"))
    out = packed
    for part in (plain, cells, tables, rest):
        out = out.unionByName(part, allowMissingColumns=True)
    return out
