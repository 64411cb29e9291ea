import random

from lectern.llm.splitting import balanced_cuts, split_oversized


def check(text, limit, overlap):
    cuts = balanced_cuts(text, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(0 < e - s <= limit or not text for s, e, _ in cuts)
    assert all(b[0] == a[1] - overlap for a, b in zip(cuts, cuts[1:]))
    return cuts


def test_properties():
    rng = random.Random(2)
    for _ in range(300):
        size = rng.randrange(0, 4000)
        text = "".join(rng.choice(["word", " ", ".", "\n", ", ", "é", "\n\n"]) for _ in range(size))
        check(text, rng.choice([50, 300, 1000]), rng.choice([0, 7, 20]))
    check("x" * 100_000, 3500, 400)


def test_fewest_pieces_at_boundaries():
    text = ("A sentence of some words here. " * 40 + "\n\n") * 4
    cuts = check(text, 3500, 400)
    assert len(cuts) == -(-(len(text) - 400) // 3100)
    assert {c[2] for c in cuts[:-1]} == {"paragraph"} or "sentence" in {c[2] for c in cuts[:-1]}
    sizes = [e - s for s, e, _ in cuts]
    assert max(sizes) - min(sizes) < 1000


def test_long_texts_take_linear_time():
    import time

    began = time.time()
    check("lorem ipsum dolor " * 300_000, 3500, 400)
    assert time.time() - began < 20


def test_operator_edges(spark):
    rows = [(1, None, "a", 9), (2, "", "b", 9), (3, "y" * 3500, "c", 9), (4, "z" * 3501, None, 9), (4, "z" * 3501, None, 9), (None, "w " * 5000, "d", 9)]
    df = spark.createDataFrame(rows, "id int, text string, locator_value string, piece_no int")
    out = split_oversized(df).collect()
    assert {r.id for r in out} == {4, None} and {r.piece_no_input for r in out} == {9}
    assert sorted(r.piece_no for r in out if r.id == 4) == [1, 1, 2, 2]
    for r in out:
        assert len(r.piece_text) <= 3500 and r.piece_end - r.piece_start == len(r.piece_text)
    assert split_oversized(df.limit(0)).count() == 0
