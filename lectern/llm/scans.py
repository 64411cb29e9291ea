"""Noise in text from scanned pages: finding it, and repairing pages into continuous paragraphs.

1. Words and word pairs are counted over all texts that are not from scans. Those that come ``LEAST`` times or more, at any
   size of the archive, are the vocabulary; it stays a table.
2. The lines of each page are compared across the pages of its document: running headers and page numbers.
3. Pages are read twice. The first reading only notes which words it asks for. The distinct ones are joined to the
   vocabulary; those it doesn't have meet the words of about their length, which lie in tries of bounded size, and get
   every word within reach by Levenshtein automata. The second reading has the answers: candidates are ranked by the
   edits that they take, of which common confusions of characters weigh least, by frequency, and by the words around.
   Words broken at line ends are put together where the vocabulary knows them without a hyphen.
4. Furniture is left out, words are repaired, and lines flow into paragraphs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import lexicon
from lectern.llm.shingles import MULTIPLIER, scramble, word_hashes
from lectern.session import durable, release

LEAST = 4
LEAST_PAGES = 3
#: Signs that tell a running line from one that recurs by chance, which no longer document can take away: ``LEAST_PAGES`` of
#: its pages lie within so many, or half of its pages have it apart by a blank line.
RUN_PAGES = 10
#: Costs of a confusion and of another edit in the score of a candidate (more in words of fewer than ``SHORT`` characters),
#: the most that the words around can add to it, and the score from which a candidate is believed that confusions alone
#: don't explain.
CONFUSION, OTHER, SHORT, AROUND, BELIEVED = 4, 8, 5, 8, -6
#: Pages that are read together, words of a trie, and unknown words that walk it in a task.
SHEAF, TRIE_WORDS, MEET = 256, 50_000, 8192
PAIRS_AT_ONCE = 1 << 17
BREAKS = "-‐‑­¬"

_WORD = re.compile(r"[^\W_]+(?:[-‐‑][^\W_]+)*")
_PART = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"(?:[^\W_]|[|!$])+(?:[.,:/\-‐‑](?:[^\W_]|[|!$])+)*")
_PIECE = re.compile(r"(?:[^\W_]|[|!$])+")
_BROKEN = re.compile(rf"([^\W\d_](?:[^\W_]|[|!$\-‐‑])*)[{BREAKS}]\s*$")
_FIRST = re.compile(r"\s*((?:[^\W_]|[|!$])+)")
_FIRST_WHOLE = re.compile(r"\s*((?:[^\W_]|[|!$])+(?:[-‐‑](?:[^\W_]|[|!$])+)*)")
_NUMBER_LINE = re.compile(r"^[\W_]*(?:page|p\.?|seite|página|pág\.?)?[\W_]*((?:[0-9a-zA-Z|!])+)(?:\s*(?:of|/|von|de|sur)\s*[0-9lIoOSB|]+)?[\W_]*$", re.IGNORECASE)
_EDGE_NUMBER = (re.compile(r"^\W*([0-9A-Za-z|!]{1,7})\W*\s{2,}"), re.compile(r"\s{2,}\W*([0-9A-Za-z|!]{1,7})\W*$"))


# 1. The vocabulary


def _pairs(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hash of each word with the next one of the same text."""
    mixed = scramble(hashes[:-1] * MULTIPLIER + hashes[1:]) if len(hashes) else hashes
    inside = np.ones(len(mixed), dtype=bool)
    ends = first[1:-1] - 1
    inside[ends[(ends >= 0) & (ends < len(mixed))]] = False
    return mixed[inside]


def counted(texts: DataFrame) -> DataFrame:
    """``word``, ``pair`` and ``n``: the counts of words (hyphenated ones whole and in parts) and, with a null word, of
    hashed pairs of words, as each task sees them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for batch in batches:
            texts = [t for t in batch.column("text").to_pylist() if t]
            for t in texts:
                found = _WORD.findall(t.lower())
                words.update(found)
                for w in found:
                    if not w.isalnum():
                        words.update(_PART.findall(w))
            pair, n = np.unique(_pairs(*word_hashes(texts)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(pair), pa.string()), pa.array(pair.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "pair", "n"])
            if len(words) > 500_000:
                yield listed(words)
                words.clear()
        yield listed(words)

    def listed(words: Counter) -> pa.RecordBatch:
        names = [_plain(w) for w in words]
        return pa.RecordBatch.from_arrays([pa.array(names, type=pa.string()), pa.nulls(len(names), pa.int64()), pa.array(words.values(), type=pa.int64())], names=["word", "pair", "n"])

    return texts.select("text").mapInArrow(run, "word string, pair long, n long")


def vocabulary(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """The words and pairs that come at least ``least`` times in ``texts``: ``word`` or ``pair``, and ``n``."""
    return durable(counted(texts).groupBy("word", "pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))


def _plain(word: str) -> str:
    return word if word.isascii() else word.replace("‐", "-").replace("‑", "-")


class Known:
    """What a reading of pages asks for: counts of words, candidates of unknown ones, and how often words follow."""

    def __init__(self, counts: dict[str, int], candidates: dict[str, list[tuple[str, int, int]]] | None = None, pairs: dict[tuple[str, str], int] | None = None) -> None:
        self.counts, self.candidates, self.pairs = counts, candidates or {}, pairs or {}
        #: Tokens that are right as they stand, wherever they stand.
        self.right: set[str] = set()

    def count(self, word: str) -> int:
        return self.counts.get(_plain(word), 0)

    def meant(self, token: str) -> list[tuple[str, int, int]]:
        """``(word, confusions, others)`` of the words within reach of a token that isn't in the vocabulary."""
        return self.candidates.get(token, [])

    def follows(self, left: str, right: str) -> int:
        return self.pairs.get((left, right), 0)

    def best(self, token: str, before: str, after: str) -> str | None:
        """The likeliest word meant by ``token`` between its neighbours; None if no candidate is believed."""
        top = None
        for word, confusions, others in self.meant(token):
            near = min(AROUND, math.log1p(self.follows(before, word)) + math.log1p(self.follows(word, after)))
            score = near + own_score(len(token), self.count(word), confusions, others)
            if (explained(len(token), confusions, others) or score >= BELIEVED) and (top is None or (score, word) > top):
                top = (score, word)
        return top and top[1]

    def settled(self, token: str) -> bool:
        """Whether an unknown token comes out the same between any words."""
        return not any(self.meant(piece) for p in _PIECE.findall(token.lower()) for piece in (p, p.rstrip("!$")))

    def also(self, text: str) -> None:
        """A text that a reading may come to, depending on what is known."""


def own_score(size: int, count: int, confusions: int, others: int) -> float:
    """The score of a candidate for a token of so many characters, without the words around it."""
    return 0.5 * math.log(max(1, count)) - (CONFUSION * confusions + OTHER * others) * max(1.0, SHORT / size)


def explained(size: int, confusions: int, others: int) -> bool:
    """Whether confusions alone explain a token, and no more than half of it."""
    return not others and 2 * confusions <= size


class Asked(Known):
    """Notes which words a reading asks for, and knows nothing."""

    def __init__(self) -> None:
        super().__init__({})
        self.words: set[str] = set()
        self.unknown: set[str] = set()

    def count(self, word: str) -> int:
        self.words.add(_plain(word))
        return 0

    def meant(self, token: str) -> list[tuple[str, int, int]]:
        self.unknown.add(token)
        return []

    def settled(self, token: str) -> bool:
        return True  # once asked for is enough

    def also(self, text: str) -> None:
        _repaired(text, self, ("", ""))


class Open(Known):
    """Notes the places where the words around decide between candidates: token, the word before and the one after."""

    def __init__(self, *known) -> None:
        super().__init__(*known)
        self.places: set[tuple[str, str, str]] = set()

    def best(self, token: str, before: str, after: str) -> str | None:
        options = self.meant(token)
        if len(options) > 1 or options and not explained(len(token), *options[0][1:]):
            self.places.add((token, before, after))
        return super().best(token, before, after)


def pair_hashes(pairs: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of two words in a row, as ``counted`` has them, and of which of ``pairs``: those that are just two words."""
    hashes, first = word_hashes([f"{left} {right}" for left, right in pairs])
    two = np.flatnonzero(np.diff(first) == 2)
    return scramble(hashes[first[two]] * MULTIPLIER + hashes[first[two] + 1]).view(np.int64), two


# 2. Furniture


def line_key(line: str) -> str:
    """A line without a page number at either end, with characters that are taken for one another made equal."""
    text = line.strip()
    for pattern in _EDGE_NUMBER:
        match = pattern.search(text)
        if match and page_values(match[1]):
            text = (text[: match.start()] + " " + text[match.end() :]).strip()
            break
    text = re.sub(r"\s+", " ", text.lower())
    text = text.translate(_ALIKE)
    for pair, one in (("rn", "m"), ("vv", "v"), ("ei", "d"), ("ii", "u")):
        text = text.replace(pair, one)
    return text


#: Characters that scanning takes for one another, each with the one that stands for them all.
_ALIKE = str.maketrans({"1": "i", "l": "i", "|": "i", "!": "i", "j": "i", "0": "o", "c": "e", "f": "e", "t": "e", "7": "e", "5": "s", "$": "s", "6": "u", "8": "u", "b": "u", "h": "u", "9": "g", "q": "g", "y": "v", "w": "v", "n": "u", "2": "z"})


def page_values(text: str) -> list[int]:
    """The numbers that a token can give: in digits, also misread ones, or as a Roman numeral ("l" is 1 or 50)."""
    if text.isdigit():
        return [int(text)] if len(text) < 8 else []
    value = lexicon.roman(text)
    meant = "".join(lexicon.DIGITS.get(c, c) for c in text)
    out = [] if value is None else [value]
    if meant.isdigit() and (len(text) < 4 or len(text) < 8 and any(c.isdigit() for c in text)):
        out.append(int(meant))
    return sorted(set(out))


def number_line(line: str) -> list[int]:
    match = _NUMBER_LINE.match(line.strip())
    return page_values(match[1]) if match else []


def edge_lines(pages: DataFrame, outer: bool) -> DataFrame:
    """The two outermost lines at either end of each page, or else those within: of its upper half from the top and the
    others from the bottom. ``id``, ``page``, ``side``, ``depth``, ``line_no``, ``run`` (a hash of document, side and the line's
    key, within also of its depth; null for a line without a key), ``of`` (a hash of document and side), whether a blank
    line (or nothing) parts it from the inner ones (``apart``), and the possible ``values`` of a line that holds only a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for ident, doc, page, text in zip(*(batch.column(c).to_pylist() for c in ("id", "doc", "page", "text"))):
                lines = text.split("\n")
                filled = [i for i, line in enumerate(lines) if line.strip()]
                half = -(-len(filled) // 2)
                sides = (filled[:2], filled[:-3:-1]) if outer else (filled[:half], filled[: half - 1 if half else None : -1])
                for side, order in zip(("top", "bottom"), sides):
                    for depth, i in enumerate(order):
                        if (depth < 2) != outer:
                            continue
                        inner = i + 1 if side == "top" else i - 1
                        apart = not (0 <= inner < len(lines) and lines[inner].strip())
                        values = number_line(lines[i])
                        key = line_key(lines[i])
                        row = (ident, doc, page, side, depth, i + 1, key if len(key) > 1 and not values else None, apart, values)
                        for name, value in zip(out, row):
                            out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("id", pa.int64()), ("doc", pa.string()), ("page", pa.int32()), ("side", pa.string()), ("depth", pa.int32()), ("line_no", pa.int32()), ("key", pa.string()), ("apart", pa.bool_()), ("values", pa.list_(pa.int32()))])
    lines = pages.filter("doc is not null").mapInArrow(run, "id long, doc string, page int, side string, depth int, line_no int, key string, apart boolean, values array<int>")
    hashed = F.when(F.col("key").isNotNull(), F.xxhash64("doc", "side", "key", F.greatest("depth", F.lit(1))))
    return lines.select("id", "page", "side", "depth", "line_no", hashed.alias("run"), F.xxhash64("doc", "side").alias("of"), "apart", "values")


def furniture(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``id`` and ``marks``: the lines of a page that are a ``header`` or ``page_number``, were all lines outside them furniture
    too (see ``page_marks``).

    A line runs through its document if its key stands on that side of at least ``least_pages`` pages and has one of two
    signs: so many of them lie within ``RUN_PAGES``, or half of them have it apart from the text by a blank line. Pages
    without a number are told apart by their id, and have the second sign only. A line with only a number is the page's
    if, over the document, numbers on that side keep one distance from the page's place (numbers below 1 being written
    as 1); a single such line must be the page's place itself. Grouping is by document and key and reduces before the
    shuffle, so a document of very many pages is no hot group. Lines within are looked at only on pages whose two outer
    lines on a side are furniture.
    """
    outer = _marked(pages, True, least_pages)
    two = outer.groupBy("id", "side").agg(F.count_distinct("depth").alias("n")).filter("n = 2").select("id").distinct()
    within = _marked(pages.join(two, "id", "left_semi"), False, least_pages)
    marks = durable(outer.union(within).groupBy("id").agg(F.collect_list(F.struct("side", "depth", "line_no", "mark")).alias("marks")))
    release(outer, within)
    return marks


def _marked(pages: DataFrame, outer: bool, least_pages: int) -> DataFrame:
    """``id``, ``side``, ``depth``, ``line_no`` and ``mark`` of the furniture among the outer lines, or among the inner ones."""
    edges = durable(edge_lines(pages, outer))
    plain = edges.filter("run is not null")
    on_page = plain.groupBy("run", "id").agg(F.max("apart").alias("apart"), F.first("page").alias("page"))
    runs = on_page.groupBy("run").agg(F.count("*").alias("pages"), F.count_if("apart").alias("apart")).filter(F.col("pages") >= least_pages)
    # Any RUN_PAGES pages in a row lie in one of the blocks of twice as many, so that no group is larger than a block.
    block = F.floor(F.col("page") / RUN_PAGES)
    in_blocks = on_page.filter("page is not null").join(runs.select("run"), "run", "left_semi").select("run", "page", F.explode(F.array(block, block - 1)).alias("block"))
    on = F.array_sort(F.collect_set("page"))
    near = F.exists(F.arrays_zip(F.col("on").alias("a"), F.slice("on", F.lit(least_pages), F.size("on")).alias("b")), lambda x: x["b"] - x["a"] < RUN_PAGES)
    dense = in_blocks.groupBy("run", "block").agg(on.alias("on")).filter(near).select("run")
    runs = runs.filter(2 * F.col("apart") >= F.col("pages")).select("run").union(dense).distinct()
    headers = plain.join(runs.select("run"), "run", "left_semi").select("id", "side", "depth", "line_no", F.lit("header").alias("mark"))
    numbers = edges.filter("page is not null and size(values) > 0").withColumn("value", F.explode("values")).withColumn("offset", F.col("value") - F.col("page"))
    steps = numbers.groupBy("of", "offset").agg(F.count_distinct("page").alias("pages"))
    steps = steps.filter("pages > 1 or offset = 0").groupBy("of").agg(F.max_by("offset", F.struct("pages", -F.abs("offset"))).alias("step"))
    of_page = numbers.join(steps, "of").filter(F.col("value") == F.greatest(F.lit(1), F.col("page") + F.col("step")))
    marks = headers.union(of_page.select("id", "side", "depth", "line_no", F.lit("page_number").alias("mark")))
    marks = durable(marks)
    release(edges)
    return marks


def page_marks(marks: list[dict] | None) -> dict[int, str]:
    """Line numbers with their mark. A line counts only where every line outside it is furniture too."""
    by = {(m["side"], m["depth"]): m for m in marks or ()}
    out = {}
    for side in ("top", "bottom"):
        depth = 0
        while mark := by.get((side, depth)):
            out[mark["line_no"]] = mark["mark"]
            depth += 1
    return out


# 3. Lines


def joined_word(first: str, second: str, longer: str, known: Known) -> tuple[bool, str]:
    """Whether a break between ``first`` and ``second`` parts a word that is written without a hyphen, and the whole.
    ``longer`` is ``second`` with what follows it after a hyphen of its own."""
    head, _, tail = first.rpartition("-") if "-" in first else ("", "", first)
    low_tail, low_second = tail.lower(), second.lower()
    whole, compound = low_tail + low_second, f"{first.lower()}-{low_second}"
    one, two = known.count(whole), max(known.count(compound), known.count(f"{first}-{longer}".lower()))
    if head and not two:
        two = known.count(f"{low_tail}-{low_second}")
    if not one and not two:
        one = max((known.count(w) for w, _, others in known.meant(whole) if not others), default=0)
    halves = known.count(low_tail), known.count(low_second)
    known.also(f"{first}-{second}")
    broken = one >= two if one or two else not all(halves)
    return broken, f"{head}-{tail}{second}" if broken and head else f"{tail}{second}" if broken else f"{first}-{second}"


def read_page(text: str, marks: dict[int, str], following: str, known: Known) -> tuple[list[tuple[int, str]], str]:
    """``(defects, repaired)`` of a page: line numbers with their defect, and the text as continuous paragraphs.

    ``following`` is the first word of the next page, for a word broken at the end of this one. A page without any word
    comes out empty.
    """
    lines = text.split("\n")
    defects = [(n, mark) for n, mark in sorted(marks.items())]
    body = [(n, line) for n, line in enumerate(lines, 1) if n not in marks]
    filled = [i for i, (_, line) in enumerate(body) if line.strip()]
    follower = {i: body[j][1] for i, j in zip(filled, filled[1:])}
    paragraphs: list[str] = []
    open_end, skip = False, ""
    for i, (number, line) in enumerate(body):
        if not line.strip():
            open_end = open_end and bool(paragraphs) and not re.search(r"[.!?:;…\"”)]\s*$", paragraphs[-1])
            continue
        following_line = follower.get(i, following)
        broken_at = _BROKEN.search(line)
        next_first = _FIRST.match(following_line or "")
        tail = ""
        wrong = False
        content = line
        if skip:
            match = _FIRST.match(content)
            content = content[match.end() :] if match else content
        if broken_at:
            first, second = broken_at[1].replace("‐", "-").replace("‑", "-"), next_first[1] if next_first else ""
            if second and second[:1].isalpha() | (second[:1] in "|!$0123456789"):
                longer = _FIRST_WHOLE.match(following_line)[1].replace("‐", "-").replace("‑", "-")
                is_broken, whole = joined_word(first, second, longer, known)
            else:
                is_broken, whole = not known.count(first.lower().rpartition("-")[2]), first
            if is_broken:
                defects.append((number, "hyphenation"))
            if i in follower and second:
                content = content[: len(content) - (len(line) - broken_at.start())] if len(content) >= len(line) - broken_at.start() else ""
                fixed, _ = _repaired(whole, known, ("", ""))
                tail = fixed
                # A misread half of a broken word belongs to the line it stands on.
                if is_broken and fixed.lower() != whole.lower():
                    half = len(first)
                    if fixed.lower()[: half - 1] != whole.lower()[: half - 1] or not second:
                        wrong = True
                    else:
                        defects.append((body[filled[filled.index(i) + 1]][0], "misread"))
        fixed, misread = _repaired(content, known)
        if misread or wrong:
            defects.append((number, "misread"))
        rest = fixed.strip()
        if tail:
            rest = f"{rest} {tail}" if rest else tail
        if paragraphs and (skip or open_end):
            glue = "" if skip and rest[:1] and not rest[:1].isalnum() else " "
            paragraphs[-1] += glue + rest if rest else ""
        else:
            paragraphs.append(rest)
        open_end = True
        skip = tail
    return sorted(set(defects)), "\n\n".join(p.strip() for p in paragraphs if p.strip())


def _repaired(line: str, known: Known, around: tuple[str, str] | None = None) -> tuple[str, bool]:
    """The line with what was meant in place of misread words and numbers, and whether there was any."""
    tokens = list(_TOKEN.finditer(line))
    out, at, misread = [], 0, False
    for k, match in enumerate(tokens):
        token = match[0]
        if token in known.right:
            continue
        low = token.lower()
        if known.count(low) or token.isdigit():
            known.right.add(token)
            continue
        number = lexicon.misread_number(token)
        if number is not None:
            replaced = number
        else:
            before = tokens[k - 1][0].lower() if k else ""
            after = tokens[k + 1][0].lower() if k + 1 < len(tokens) else ""
            replaced = _PIECE.sub(lambda m: _meant(m[0], before, after, known), token)
        if replaced == token:
            if known.settled(token):
                known.right.add(token)
        else:
            misread = True
            out.append(line[at : match.start()] + replaced)
            at = match.end()
    return "".join(out) + line[at:], misread


def _meant(piece: str, before: str, after: str, known: Known) -> str:
    low = piece.lower()
    if known.count(low) or not any(c.isalpha() for c in piece):
        return piece
    trimmed = low.rstrip("!$") if low.rstrip("!$|").isalpha() else low
    if known.count(trimmed):
        return piece
    best = known.best(low, before, after)
    if best is None:
        return piece
    if piece.isupper() and len(piece) > 1:
        return best.upper()
    return best[:1].upper() + best[1:] if piece[:1].isupper() else best


def scanned_pages(chunks: DataFrame, id: str, doc: str, page: str, text: str) -> DataFrame:
    """``id``, ``doc``, ``page``, ``text``: each page once."""
    slim = chunks.select(F.col(id).cast("long").alias("id"), F.col(doc).cast("string").alias("doc"), F.col(page).try_cast("int").alias("page"), F.col(text).alias("text"))
    return slim.filter("id is not null and text is not null").dropDuplicates(["id"])


def _asked(pages: DataFrame) -> DataFrame:
    """The words that the reading of ``pages`` asks for, once a ``sheaf``: ``token``, and whether it wants candidates if it is
    ``unknown``."""

    def run(batch: pa.Table) -> pa.Table:
        asked = Asked()
        for text, own, following in zip(*(batch.column(c).to_pylist() for c in ("text", "marks", "following"))):
            read_page(text, page_marks(own), following or "", asked)
        words = sorted(asked.words | asked.unknown)
        sheaf = pa.array(np.full(len(words), batch.column("sheaf")[0].as_py(), np.int64))
        return pa.table({"sheaf": sheaf, "token": pa.array(words, type=pa.string()), "unknown": pa.array([w in asked.unknown for w in words], type=pa.bool_())})

    return pages.groupBy("sheaf").applyInArrow(run, "sheaf long, token string, unknown boolean")


def candidates(tokens: DataFrame, words: DataFrame, trie_words: int = TRIE_WORDS) -> DataFrame:
    """``token``, ``word``, ``n``, ``confusions`` and ``others`` for every word within two edits of each distinct token that
    could be believed somewhere, with all that words around can add.

    Words (``word``, ``n``) lie in tries by their length; a length with more than ``trie_words`` is cut by a hash, so that no
    trie is larger. A token meets the tries of the lengths that two edits can reach.
    """
    sized = words.select("word", "n", F.length("word").alias("size"))
    large = sized.groupBy("size").count().filter(F.col("count") > trie_words).collect()  # a row for a length of word
    parts = F.coalesce(F.create_map(*[F.lit(x) for r in large for x in (r["size"], -(-r["count"] // trie_words))])[F.col("size")], F.lit(1)) if large else F.lit(1)
    own = sized.select("word", "n", "size", F.pmod(F.xxhash64("word"), parts).alias("part"))
    each = tokens.select("token", F.explode(F.sequence(F.greatest(F.lit(1), F.length("token") - lexicon.EDITS), F.length("token") + lexicon.EDITS)).alias("size"))
    each = each.select("token", "size", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).alias("part"))
    # Many tokens of one length are spread over tasks, each of which walks the same trie.
    spreads = F.lit(max(1, -(-tokens.count() // MEET))).cast("long")
    each = each.withColumn("spread", F.pmod(F.xxhash64("token"), spreads))
    own = own.withColumn("spread", F.explode(F.sequence(F.lit(0).cast("long"), spreads - 1)))

    def run(asking: pa.Table, having: pa.Table) -> pa.Table:
        tokens, known = asking.column("token").to_pylist(), dict(zip(having.column("word").to_pylist(), having.column("n").to_pylist()))
        out: list[tuple] = []
        if tokens and known:
            trie = lexicon.Trie(list(known))
            t, w = trie.within(tokens)
            for begin in range(0, len(t), PAIRS_AT_ONCE):
                read, meant = [tokens[i] for i in t[begin : begin + PAIRS_AT_ONCE]], [trie.words[i] for i in w[begin : begin + PAIRS_AT_ONCE]]
                for token, word, confusions, others in zip(read, meant, *(x.tolist() for x in lexicon.misreadings(read, meant))):
                    if explained(len(token), confusions, others) or AROUND + own_score(len(token), known[word], confusions, others) >= BELIEVED:
                        out.append((token, word, known[word], confusions, others))
        return pa.table([pa.array(c, type=t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()))], names=["token", "word", "n", "confusions", "others"])

    keys = ("size", "part", "spread")
    return each.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(run, "token string, word string, n long, confusions int, others int")


ANSWERS = {"token": "string", "word": "string", "n": "long", "confusions": "int", "others": "int"}


def _answers(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select("sheaf", *[F.col(c) if c in names else F.lit(None).cast(t).alias(c) for c, t in ANSWERS.items()])


def _given(answers: pa.Table) -> tuple[dict, dict, dict]:
    """Counts of words, candidates of tokens and counts of pairs (which are without edits), from the answers to one sheaf."""
    counts: dict[str, int] = {}
    options: dict[str, list] = {}
    pairs: dict[tuple[str, str], int] = {}
    for token, word, n, confusions, others in zip(*(answers.column(c).to_pylist() for c in ANSWERS)):
        if word is None:
            counts[token] = n
        elif others is None:
            pairs[token, word] = n
        else:
            options.setdefault(token, []).append((word, confusions, others))
            counts[word] = n
    return counts, options, pairs


def _pages(table: pa.Table) -> Iterator[tuple]:
    return zip(*(table.column(c).to_pylist() for c in ("id", "text", "marks", "following")))


def _wanted_pairs(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """``sheaf``, ``token``, ``word`` and their hash ``pair``: words in a row that decide between candidates."""

    def run(own: pa.Table, given: pa.Table) -> pa.Table:
        known = Open(*_given(given))
        for _, text, marks, following in _pages(own):
            read_page(text, page_marks(marks), following or "", known)
        both = sorted({p for token, before, after in known.places for word, *_ in known.meant(token) for p in ((before, word), (word, after)) if all(p)})
        hashes, which = pair_hashes(both)
        columns = [pa.array([both[i][side] for i in which], type=pa.string()) for side in (0, 1)]
        return pa.table([pa.array(np.full(len(which), own.column("sheaf")[0].as_py() if len(which) else 0, np.int64)), *columns, pa.array(hashes)], names=["sheaf", "token", "word", "pair"])

    return pages.groupBy("sheaf").cogroup(answers.groupBy("sheaf")).applyInArrow(run, "sheaf long, token string, word string, pair long")


def repaired_pages(pages: DataFrame, clean: DataFrame, id: str = "rowid", doc: str = "document_id", page: str = "page_number", text: str = "text", least_pages: int = LEAST_PAGES) -> DataFrame:
    """``id``, ``defects`` (array of ``line_no``, ``defect``) and ``repaired`` for every scanned page of ``pages``.

    ``clean`` has the ``text`` that the vocabulary is counted over. Lines are divided at ``\\n`` and counted from 1.

    Null texts and ids are left out; an empty page has no defects and comes out empty. A page without a document or a
    number has no furniture that must be compared by them. Repeated rows of a page count once. An empty ``clean`` table
    knows no words: only furniture and misread numbers are found, and word breaks by soft hyphens. Very long pages are
    read whole. Extra columns are ignored.
    """
    every = durable(scanned_pages(pages, id, doc, page, text))
    marks = furniture(every, least_pages)
    # The first word of the following page: an equality join, so that a document of very many pages is spread.
    marked = durable(every.join(marks, "id", "left"))
    starts = marked.filter("page is not null and doc is not null").select("doc", (F.col("page") - 1).alias("page"), "text", "marks")
    starts = starts.mapInArrow(_first_words, "doc string, page int, following string").groupBy("doc", "page").agg(F.min("following").alias("following"))
    sheaves = max(1, -(-every.count() // SHEAF))
    sheaf = F.pmod(F.xxhash64("id"), F.lit(sheaves)).alias("sheaf")
    laid = durable(marked.join(starts, ["doc", "page"], "left").select(sheaf, "id", "text", "marks", "following"))
    release(every, marks, marked)

    known = vocabulary(clean)
    counts = known.filter("word is not null").select("word", "n")
    found = durable(_asked(laid).join(counts.withColumnRenamed("word", "token"), "token", "left").select("sheaf", "token", "unknown", "n"))
    strange = durable(found.filter("unknown and n is null").select("token").distinct())
    options = durable(candidates(strange, counts.filter(F.col("word").rlike(r"^\p{L}+$"))))
    answers = _answers(found.filter("n is not null"), "token", "n")
    answers = durable(answers.union(_answers(found.filter("unknown and n is null").select("sheaf", "token").join(options, "token"), "token", "word", "n", "confusions", "others")))
    pairs = _wanted_pairs(laid, answers).join(known.filter("pair is not null").select("pair", "n"), "pair")
    answers = answers.union(_answers(pairs, "token", "word", "n"))
    release(found, strange, options)

    def run(own: pa.Table, given: pa.Table) -> pa.Table:
        words = Known(*_given(given))
        out: dict[str, list] = {"id": [], "defects": [], "repaired": []}
        for ident, page_text, marks, following in _pages(own):
            defects, repaired = read_page(page_text, page_marks(marks), following or "", words)
            out["id"].append(ident), out["repaired"].append(repaired)
            out["defects"].append([{"line_no": n, "defect": d} for n, d in defects])
        return pa.Table.from_pydict(out, schema=schema)

    schema = pa.schema([("id", pa.int64()), ("defects", pa.list_(pa.struct([("line_no", pa.int32()), ("defect", pa.string())]))), ("repaired", pa.string())])
    return laid.groupBy("sheaf").cogroup(answers.groupBy("sheaf")).applyInArrow(run, "id long, defects array<struct<line_no: int, defect: string>>, repaired string")


def _first_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc", pa.string()), ("page", pa.int32()), ("following", pa.string())])
    for batch in batches:
        out: dict[str, list] = {f.name: [] for f in schema}
        for doc, page, text, marks in zip(*(batch.column(c).to_pylist() for c in ("doc", "page", "text", "marks"))):
            taken = page_marks(marks)
            word = ""
            for number, line in enumerate(text.split("\n"), 1):
                if line.strip() and number not in taken:
                    match = _FIRST.match(line)
                    word = match[1] if match else ""
                    break
            out["doc"].append(doc), out["page"].append(page), out["following"].append(word)
        yield pa.RecordBatch.from_pydict(out, schema=schema)
