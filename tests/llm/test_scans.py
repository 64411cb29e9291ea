import random
from functools import lru_cache

from lectern.llm import lexicon, scans
from lectern.llm.scans import Known, line_key, number_line, read_page

WORDS = "the scheme market tolerance audit equation return kernel window shows that depends on side buy of sample hedged continuous yield for each commission library".split()


class Vocabulary(Known):
    """All candidates of a token, found when it is asked for."""

    def meant(self, token):
        if token not in self.candidates:
            out = []
            words = [w for w in self.counts if w.isalpha()]
            for size in {len(w) for w in words}:
                trie = lexicon.Trie([w for w in words if len(w) == size])
                found = [trie.words[w] for w in trie.within([token])[1].tolist()]
                out += zip(found, *(x.tolist() for x in lexicon.misreadings([token] * len(found), found)))
            self.candidates[token] = out
        return self.candidates[token]


def vocabulary(**more):
    return Vocabulary({**{w: 50 for w in WORDS}, "buy-side": 20, "out-of-sample": 9, **more})


def distance(a, b):
    """Edits with merges and splits, by the recurrence itself."""

    @lru_cache(maxsize=None)
    def d(i, j):
        if not i or not j:
            return i + j
        best = min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        if i > 1:
            best = min(best, d(i - 2, j - 1) + 1)
        if j > 1:
            best = min(best, d(i - 1, j - 2) + 1)
        return best

    return d(len(a), len(b))


def test_candidates_are_complete():
    rng = random.Random(1)
    words = {"".join(rng.choice("abcr nm".replace(" ", "")) for _ in range(rng.randrange(1, 7))) for _ in range(400)}
    tokens = sorted({"".join(rng.choice("abcrnm") for _ in range(rng.randrange(1, 9))) for _ in range(60)})
    for size in range(1, 7):
        own = [w for w in words if len(w) == size]
        trie = lexicon.Trie(own)
        got = {(tokens[t], trie.words[w]) for t, w in zip(*trie.within(tokens))}
        assert got == {(t, w) for t in tokens for w in own if distance(t, w) <= 2}


def test_confusions():
    def misreadings(read, meant):
        confusions, others = lexicon.misreadings([read], [meant])
        return int(confusions[0]), int(others[0])

    assert misreadings("scherne", "scheme") == (1, 0) and misreadings("auclit", "audit") == (1, 0)
    assert misreadings("eqiiati0n", "equation") == (2, 0) and misreadings("kemel", "kernel") == (1, 0)
    assert misreadings("drift", "drifts") == (0, 1) and misreadings("7lme", "time") == (2, 0) and misreadings("modol", "model") == (0, 1)
    many = lexicon.misreadings(["7lme", "cat", "cat"], ["time", "cat", "cut"])
    assert many[0].tolist() == [2, 0, 0] and many[1].tolist() == [0, 0, 1]
    assert lexicon.misread_number("l3.9%") == "13.9%" and lexicon.misread_number("4S6") == "456"
    assert lexicon.misread_number("13.9") is None and lexicon.misread_number("QFIN7110") is None and lexicon.misread_number("SO") is None
    assert [lexicon.roman(x) for x in ("xlix", "IV", "iiii", "", "vx")] == [49, 4, None, None, None]


def test_candidates_are_weighed_not_excluded():
    known = vocabulary(model=50, time=50)
    assert known.best("modol", "", "") is None  # one edit that scanning doesn't make needs words around it
    known.pairs["the", "model"] = 20
    assert known.best("modol", "the", "") == "model" and known.best("mxdel", "the", "") == "model"
    assert known.best("7lme", "", "") == "time"
    assert known.best("l", "", "") is None


def test_number_lines_and_keys():
    assert [number_line(x) for x in ("12", "- 7 -", "Page 41 of 49", "[lO]", "xii", "l", "Notes by X", "29.886")] == [[12], [7], [41], [10], [12], [1, 50], [], []]
    assert line_key("Bond Duality   12") == line_key("13   B0nd Duality") == line_key("Bond Dualify")
    assert line_key("SFLF-FINANCING") == line_key("SELF-FINANCING") and line_key("Notes by X") != line_key("Notes by Z")


def test_page():
    text = "\n".join(["HEAD   3", "", "The scherne shows that the rnarket de-", "pends on the l3.5 tolerance of the buy-", "side audit. The cont\xad", "inuous yi eld", "", "x"])
    defects, repaired = read_page(text, {1: "header", 8: "page_number"}, "", vocabulary(depends=5))
    assert defects == [(1, "header"), (3, "hyphenation"), (3, "misread"), (4, "misread"), (5, "hyphenation"), (8, "page_number")]
    assert repaired == "The scheme shows that the market depends on the 13.5 tolerance of the buy-side audit. The continuous yi eld"


def test_page_edges():
    known = vocabulary()
    assert read_page("", {}, "", known) == ([], "")
    assert read_page("\n\n", {}, "", known) == ([], "")
    assert read_page("hedged yie-", {}, "ld", known)[0] == [(1, "hyphenation")]
    assert read_page("out-of-sam-\nple", {}, "", known)[0] == [(1, "hyphenation")]
    assert read_page("out-\nof-sample", {}, "", known)[0] == []
    assert read_page("the end.\n\nthe next", {}, "", known)[1] == "the end.\n\nthe next"
    empty = Known({})
    assert read_page("any w0rd 4O2\n-\n- - -", {}, "", empty)[0] == [(1, "misread")]


def test_operator(spark):
    body = "the scheme shows that the market depends on the tolerance of each audit"
    clean = spark.createDataFrame([(body + " continuous yield",)] * 6 + [(None,), ("",)], "text string")
    pages = []
    for n in range(1, 6):
        lines = [f"Course   {n}" if n % 2 else f"{n}   C0urse", "", " ".join(body.split()[n:]), "the con-" if n == 2 else "the audit", "tinuous yield" if n == 2 else f"of each rnarket {WORDS[n]}", "", str(n + 4)]
        pages.append((n, "d", n, "\n".join(lines), "x"))
    pages += [pages[0], (50, "d", None, None, "x"), (51, "e", 1, "", "x"), (None, "d", 9, "a", "x"), (52, None, None, "Course", "x"), (53, "f", 7, "body text\n7", "x"), (54, "f", 9, "body text\n31", "x")]
    df = spark.createDataFrame(pages, "rowid long, document_id string, page_number int, text string, marks string")
    out = {r.id: ([(d.line_no, d.defect) for d in r.defects], r.repaired) for r in scans.repaired_pages(df, clean).collect()}
    assert set(out) == {1, 2, 3, 4, 5, 51, 52, 53, 54}
    assert out[2] == ([(1, "header"), (4, "hyphenation"), (7, "page_number")], " ".join(body.split()[2:]) + " the continuous yield")
    assert out[3][0] == [(1, "header"), (5, "misread"), (7, "page_number")] and out[3][1].endswith(f"the audit of each market {WORDS[3]}")
    assert out[51] == ([], "") and out[52][0] == [] and out[53][0] == [(2, "page_number")] and out[54][0] == []
    nothing = scans.repaired_pages(df.limit(0), clean.limit(0))
    assert nothing.count() == 0


def test_counts(spark):
    df = spark.createDataFrame([("one two one-two two",), ("two",), (None,)], "text string")
    rows = scans.vocabulary(df, least=1).collect()
    assert {r.word: r.n for r in rows if r.word} == {"one": 2, "two": 4, "one-two": 1}
    asked = [("one", "two"), ("one-two", "two"), ("two", "one"), ("two", "three"), ("", "two")]
    hashes, which = scans.pair_hashes(asked)
    pairs = {r.pair: r.n for r in rows if not r.word}
    assert {asked[i]: pairs.get(h, 0) for i, h in zip(which.tolist(), hashes.tolist())} == {("one", "two"): 2, ("two", "one"): 1, ("two", "three"): 0}


def test_candidates_by_joins(spark):
    words = [(w, 50) for w in (*WORDS, "model", "time")]
    counts = spark.createDataFrame(words, "word string, n long")
    tokens = spark.createDataFrame([("modol",), ("7lme",), ("scherne",), ("x" * 40,)], "token string")
    for size in (50_000, 3):
        got = {(r.token, r.word): (r.n, r.confusions, r.others) for r in scans.candidates(tokens, counts, size).collect()}
        assert got == {("modol", "model"): (50, 0, 1), ("7lme", "time"): (50, 2, 0), ("7lme", "the"): (50, 1, 1), ("scherne", "scheme"): (50, 1, 0)}


def test_running_lines_of_long_documents(spark):
    clean = spark.createDataFrame([("the scheme shows that the market depends on the tolerance",)] * 6, "text string")
    pages = []
    for n in range(1, 121):
        own = "".join("adgkmopx"[n // 8**i % 8] for i in range(3))  # letters that aren't taken for one another
        lines = [f"opening {own}", f"middle {own}", "the tolerance" if n in (9, 50, 93) else f"closing {own}"]
        if 20 <= n < 24:
            lines[:0] = ["Chapter of Audit"]
        if n in (30, 60, 90):
            lines += ["", "Part of Library"]
        pages.append((n, "d", n, "\n".join(lines)))
    df = spark.createDataFrame(pages, "rowid long, document_id string, page_number int, text string")
    marks = {(r.id, m.line_no) for r in scans.furniture(scans.scanned_pages(df, "rowid", "document_id", "page_number", "text")).collect() for m in r.marks if m.mark == "header"}
    assert marks == {(n, 1) for n in range(20, 24)} | {(n, 5) for n in (30, 60, 90)}


def test_three_header_lines_a_chapter_and_pages_without_a_number(spark):
    pages = []
    for n in range(1, 400):
        own = "".join("adgkmopx"[n // 8**i % 8] for i in range(3))
        lines = [f"opening {own}", f"middle {own}", f"inner {own}", f"closing {own}"]
        if n % 50 < 12:
            lines[:0] = ["University of Audit", "Library of Kernels", f"Chapter {'adgkmopx'[n // 50]}"]
        pages.append((n, "d", n, "\n".join(lines)))
    pages += [(1000 + n, "e", None, f"Notes of Audit\n\nbody {'adgkmopx'[n]}\nlast {'kxoadgmp'[n]}") for n in range(5)]
    df = spark.createDataFrame(pages, "rowid long, document_id string, page_number int, text string")
    marks = scans.furniture(scans.scanned_pages(df, "rowid", "document_id", "page_number", "text")).collect()
    found = {r.id: sorted(scans.page_marks([m.asDict() for m in r.marks])) for r in marks}
    assert {i: x for i, x in found.items() if x} == {**{n: [1, 2, 3] for n in range(1, 400) if n % 50 < 12}, **{1000 + n: [1] for n in range(5)}}
