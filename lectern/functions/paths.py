"""What a path in the archive says about its file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path components that are never read.
IGNORED = [".git", ".rag", ".DS_Store", "__pycache__", ".ipynb_checkpoints"]
#: The folder of what belongs to no term, and the form of a term's folder.
PROGRAM = "Program-wide"
TERM = r"^(Fall|Spring|Summer|Winter) \d{4}$"
#: Folders that name the role of what they hold.
FOLDER_ROLES = (
    "lectures assignments assessments solutions readings reference resources computational code data workbooks experiments source sessions topics "
    "applications syllabi assets"
).split()
#: The content type that a folder stands for in the index.
FOLDER_TYPES = {
    "lectures": "lecture", "lecture_slides": "lecture", "readings": "reading", "reference": "reference", "references": "reference", "resources": "reference",
    "assignments": "assignment", "questions": "assignment", "assessments": "assessment", "solutions": "solution", "workbooks": "workbook", "data": "data",
    "code": "code", "computational": "code", "source": "code", "experiments": "experiment", "sessions": "seminar", "assets": "image", "visuals": "image",
    "topics": "topic", "applications": "application", "syllabi": "syllabus",
}
#: How a file of an extension is read.
ROUTES = {
    ".pdf": "pdf", ".pptx": "pptx", ".ppt": "legacy_presentation", ".docx": "docx", ".doc": "legacy_document", ".xlsx": "spreadsheet", ".xlsm": "spreadsheet",
    ".xls": "legacy_spreadsheet", ".csv": "dataset", ".tsv": "dataset", ".ipynb": "notebook", ".py": "source_code", ".c": "source_code", ".m": "source_code",
    ".r": "source_code", ".tex": "source_code", ".txt": "text", ".md": "markdown", ".jpg": "image", ".jpeg": "image", ".png": "image", ".gif": "image", ".zip": "archive",
}
#: Fixed value: from this size on, a dataset is large.
LARGE_BYTES = 5 * 1024 * 1024


def lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def parts(path: Column) -> Column:
    return F.split(path, "/")


def name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def suffix(path: Column) -> Column:
    """The extension in lower case with its dot; empty for none, and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]+$", "")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ignored(path: Column) -> Column:
    return F.arrays_overlap(parts(path), F.array(*[F.lit(x) for x in IGNORED]))


def in_source_root(path: Column) -> Column:
    """Whether the path lies below a term's folder or the program-wide one."""
    top = F.get(parts(path), F.lit(0))
    return (F.size(parts(path)) > 1) & (top.rlike(TERM) | (top == PROGRAM))


def route(path: Column) -> Column:
    return F.coalesce(lookup(suffix(path), ROUTES), F.lit("unsupported"))


def route_of(name: str) -> str:
    """``route`` of one name, inside a task."""
    last = name.rpartition("/")[2]
    at = last.rfind(".")
    return ROUTES.get(last[at:].lower(), "unsupported") if at > 0 else "unsupported"


def context(path: Column) -> dict[str, Column]:
    """``term``, ``course``, ``content_role`` and ``access_review`` as the manifest has them.

    The role is that of the first folder with a role. Without one it is the second component below the course's folder,
    which for a file in a single unknown folder is the file's name.
    """
    every, top = parts(path), F.get(parts(path), F.lit(0))
    term = F.when(top.rlike(TERM), top)
    start = F.when(term.isNotNull(), 2).when(top == PROGRAM, 1).otherwise(0)
    inner = F.transform(F.slice(every, start + 1, F.greatest(F.lit(0), F.size(every) - 1 - start)), lambda p: F.lower(p))
    known = F.get(F.filter(inner, lambda p: p.isin(FOLDER_ROLES)), F.lit(0))
    other = F.when(F.size(every) > start + 1, F.lower(F.get(every, start + 1)))
    guarded = F.exists(every, lambda p: F.lower(p).isin("solutions", "assessments"))
    return {
        "term": term,
        "course": F.when(term.isNotNull(), F.get(every, F.lit(1))),
        "content_role": F.coalesce(known, other),
        "access_review": F.when(guarded, "review_required").otherwise("not_reviewed"),
    }


def metadata(path: Column) -> dict[str, Column]:
    """``course``, ``course_label``, ``content_type``, ``folder``, ``file_type``, ``lecturer``, ``version_family`` and
    ``version_label`` as the index has them. The type is that of the last folder with one, unless the name says more."""
    every, top = parts(path), F.get(parts(path), F.lit(0))
    label = F.when((top != PROGRAM) & (F.size(every) > 1), F.get(every, F.lit(1))).otherwise("")
    folders = F.transform(F.slice(every, 3, F.greatest(F.lit(0), F.size(every) - 3)), lambda p: F.lower(p))
    typed = F.filter(F.transform(folders, lambda f: lookup(f, FOLDER_TYPES)), lambda t: t.isNotNull())
    title = F.lower(stem(path))
    kind = (
        F.when(F.contains(title, F.lit("solution")) | F.contains(title, F.lit("answer key")) | F.array_contains(folders, "solutions"), "solution")
        .when(F.array_contains(folders, "assessments") | title.rlike(r"\b(exam|midterm|quiz)\b"), "assessment")
        .when(F.contains(title, F.lit("syllabus")) | F.array_contains(folders, "syllabi"), "syllabus")
        .when(name(path) == "README.md", "course_map")
        .otherwise(F.coalesce(F.try_element_at(typed, F.lit(-1)), F.lit("other")))
    )
    at = F.array_position(every, "sessions")
    lecturer = F.when((at > 0) & (at < F.size(every) - 1), F.regexp_replace(F.get(every, at.cast("int")), r"^\d{4}\s+", "")).otherwise("")
    bare = F.regexp_replace(stem(path), r"(?i)\s*\[Ver\s+\d+\]", "")
    family = F.when(parent(path) != "", F.concat_ws("/", parent(path), bare)).otherwise(bare)
    return {
        "course": F.split_part(label, F.lit(" - "), F.lit(1)),
        "course_label": label,
        "content_type": kind,
        "folder": F.when(parent(path) != "", parent(path)).otherwise("."),
        "file_type": F.ltrim(suffix(path), F.lit(".")),
        "lecturer": lecturer,
        "version_family": F.substring(F.sha2(F.lower(family).cast("binary"), 256), 1, 24),
        "version_label": F.nullif(F.regexp_extract(stem(path), r"(?i)\[Ver\s+(\d+)\]", 1), F.lit("")),
    }


def effective(path: Column, kind: Column, term: Column, access: Column) -> dict[str, Column]:
    """``term`` and ``review`` as searches filter by them: a file without a term of its own has that of its top folder if it
    is for the whole program, and solutions, assessments and archives are always to be reviewed."""
    top = F.get(parts(path), F.lit(0))
    guarded = kind.isin("solution", "assessment") | (suffix(path) == ".zip")
    return {
        "term": F.coalesce(F.nullif(term, F.lit("")), F.when(top == PROGRAM, PROGRAM), F.lit("")),
        "review": F.when(guarded, "review_required").otherwise(F.coalesce(access, F.lit("not_reviewed"))),
    }


def review_reasons(route: Column, size: Column, access: Column) -> Column:
    """What about a file asks for a look."""
    return F.array_compact(
        F.array(
            F.when(route == "unsupported", "unsupported_extension"),
            F.when(route.startswith("legacy_"), "legacy_office_format"),
            F.when((route == "dataset") & (size >= LARGE_BYTES), "large_structured_dataset"),
            F.when(access == "review_required", "assessment_or_solution_material"),
            F.when(route == "image", "visual_asset_needs_ocr_or_caption_review"),
        )
    )
