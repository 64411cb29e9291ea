"""Text expressions: normal forms, tokens, windows, classifiers. JVM built-ins, but for two Unicode forms that Spark lacks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a query.
STOP_WORDS = (
    "a an the and or of in on at to for from with as is are was were be been this that these those how what which when where why does do did can could "
    "would should i me my you your please explain describe show find give about"
).split()
#: The further ones that keyword lists leave out.
MORE_STOP_WORDS = "it its into by using use used between vs versus there their them they we our us than then so if not no yes any all some such".split()
#: Greek letters written out in searches.
GREEK = dict(zip("αβγδθελμρστφω", "alpha beta gamma delta theta epsilon lambda mu rho sigma tau phi omega".split()))
#: Words that make a question depend on an earlier one.
FOLLOW_UP = r"(?i)\b(it|its|they|them|their|this|that|these|those|also|instead|more|above|previous|example)\b"
#: What makes a text look like an instruction to a model.
INSTRUCTION = (
    r"(?i)ignore\s+(?:(?:all|any|the|previous|prior|above)\s+)*(?:instructions|rules|prompts)"
    r"|(?:system|developer|assistant)\s*(?:message|prompt|instruction)?\s*:"
    r"|(?:reveal|output|print|send)\s+(?:the\s+|your\s+)?(?:password|secret|api\s*key)"
    r"|<\|(?:im_start|system|assistant)\|>"
)
#: Words by which a question is about a table, asks for a number, or looks something up.
TABLE_WORDS = r"(?i)\b(csv|tsv|xlsx?|spreadsheet|workbook|dataset|data set|column|rows?|cells?|sheet)\b"
NUMBER_WORDS = r"(?i)\b(calculate|compute|sum|average|mean|median|standard deviation|stddev|minimum|maximum|total|how many|count)\b"
LOOKUP_WORDS = r"(?i)\b(show|list|inspect|lookup|look up|filter|range|formula|schema)\b"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(text: Column) -> Column:
    """Lower case for A to Z only, as a case-insensitive comparison in plain ASCII has it."""
    return F.translate(text, UPPER, LOWER)


def normal_whitespace(text: Column) -> Column:
    """No NULs, line feeds for all line ends, single blanks, at most one empty line, nothing around."""
    text = F.regexp_replace(F.replace(text, F.lit("\0"), F.lit("")), r"\r\n?", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+\z", "")


_WRITTEN_OUT = str.maketrans({sign: f" {name} " for letter, name in GREEK.items() for sign in (letter, letter.upper())})


def _folded(text: str) -> str:
    """Greek letters by name, case folded, compatibility forms taken apart, without accents."""
    text = unicodedata.normalize("NFKD", text.translate(_WRITTEN_OUT).casefold())
    return "".join(c for c in text if not unicodedata.combining(c))


def search_form(text: Column) -> Column:
    """What searches compare: Greek letters by name, case folded, compatibility forms taken apart, without accents, and
    blanks for underscores, slashes and dashes. Only texts beyond ASCII go to Python."""

    @F.pandas_udf("string")
    def fold(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(_folded, na_action="ignore")

    folded = F.coalesce(fold(F.when(text.rlike(r"[^\x00-\x7f]"), text)), F.lower(text))
    return F.regexp_replace(folded, r"[_/\\\-–—]+", " ")


def quote_form(text: Column) -> Column:
    """What quotations compare: compatibility forms composed, and single blanks for all white space."""

    @F.pandas_udf("string")
    def compose(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    composed = F.coalesce(compose(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)
    return F.trim(F.regexp_replace(composed, r"[\s\p{Z}]+", " "))


def words(text: Column) -> Column:
    """The runs of letters and digits."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1)


def query_terms(query: Column, most: int | None = 32) -> Column:
    """The distinct words of a query in search form, in order, without stop words: the first ``most``, or all."""
    terms = F.array_distinct(F.filter(words(query), lambda w: ~w.isin(STOP_WORDS)))
    return terms if most is None else F.slice(terms, 1, most)


def keywords(text: Column) -> Column:
    """The distinct lower-case words of more than one character, in order, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}][\p{L}\p{N}'’\-]*)"), 1)
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS + MORE_STOP_WORDS)))


def probe_query(title: Column, text: Column, count: int = 8) -> Column:
    """A query made of a record's own first meaningful words, to see whether a search finds it again."""
    found = words(F.lower(F.concat_ws(" ", title, text)))
    kept = F.filter(found, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS) & ~w.rlike(r"^\p{N}+$"))
    return F.array_join(F.slice(F.array_distinct(kept), 1, count), " ")


def unit_of(header: Column) -> Column:
    """The first bracketed text of a column's header, else ``unknown``."""
    return F.coalesce(F.nullif(F.regexp_extract(header, r"[\[(]([^\])]+)[\])]", 1), F.lit("")), F.lit("unknown"))


def instruction_like(text: Column) -> Column:
    return F.coalesce(text.rlike(INSTRUCTION), F.lit(False))


def question_kind(question: Column) -> Column:
    """``computation``, ``structured_lookup`` or ``text``."""
    about, number, lookup = (question.rlike(p) for p in (TABLE_WORDS, NUMBER_WORDS, LOOKUP_WORDS))
    return F.when(about & number, "computation").when(about & lookup, "structured_lookup").otherwise("text")


def occurrences(text: Column, term: Column) -> Column:
    """How often ``term`` stands in ``text``, without overlaps."""
    size = F.length(term)
    return F.when(size > 0, F.floor((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / size)).otherwise(0).cast("int")


def best_excerpt(text: Column, terms: Sequence[str], limit: int = 2300) -> Column:
    """Of the windows of ``limit`` characters that begin every half of it, the first with the most occurrences of terms."""
    low = F.lower(text)

    def hits(start: Column) -> Column:
        window = F.substring(low, start + 1, F.lit(limit))
        return sum((occurrences(window, F.lit(t)) for t in terms), F.lit(0))

    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - 1), F.lit(limit // 2))
    ranked = F.transform(starts, lambda s: F.struct(hits(s).alias("n"), (-s).alias("s")))
    return F.when(F.length(text) <= limit, text).otherwise(F.substring(text, 1 - F.array_max(ranked)["s"], F.lit(limit)))


def passage(text: Column, terms: Sequence[str], size: int = 1300, before: int = 250) -> Column:
    """``size`` characters from ``before`` ahead of the earliest term."""
    found = F.filter(F.array(*[F.instr(F.lower(text), t) for t in terms]), lambda at: at > 0)
    at = F.greatest(F.lit(0), F.coalesce(F.array_min(found) - 1, F.length(text)) - before)
    return F.when(F.length(text) <= size, text).otherwise(F.substring(text, at + 1, F.lit(size)))
