import datetime

from lectern.operators.snapshots import archive_changes, changes

DAY = datetime.datetime(2031, 1, 1)


def rows(df):
    return sorted((r.snapshot_no, r.path, r.change, tuple(r.changed_fields)) for r in df.collect())


def sources(spark, data):
    schema = "snapshot_no int, delivered_at timestamp_ntz, path string, content_hash string, term string, path_input string"
    return spark.createDataFrame([(s, DAY + datetime.timedelta(hours=h), p, c, t, "x") for s, h, p, c, t in data], schema)


def test_added_deleted_changed_and_written_alike(spark):
    df = sources(spark, [
        (1, 0, "a/b", "AA", None), (1, 0, "gone", "11", None), (1, 0, "same", "sha256:Bb", "t"), (1, 0, "nul", None, None),
        (3, 0, "./a\\b", "ab", None), (3, 0, "same", "bb", "u"), (3, 0, "nul", None, None), (3, 0, "new", None, None), (3, 0, "Same", "bb", None),
    ])
    assert rows(archive_changes(df)) == [(3, "Same", "added", ()), (3, "a/b", "changed", ("content_hash",)), (3, "gone", "deleted", ()), (3, "new", "added", ())]
    wide = rows(archive_changes(df, ["content_hash", "term"]))
    assert (3, "same", "changed", ("term",)) in wide and (3, "a/b", "changed", ("content_hash",)) in wide


def test_latest_row_counts_and_repeats_once(spark):
    df = sources(spark, [(1, 0, "a", "1", None), (1, 5, "a", "2", None), (1, 5, "a", "2", None), (2, 9, "a", "2", None), (2, 0, "a", "7", None)])
    assert rows(archive_changes(df)) == []


def test_null_hash_equals_only_null(spark):
    df = sources(spark, [(1, 0, "a", None, None), (2, 0, "a", "1", None), (3, 0, "a", None, None)])
    assert [r[:3] for r in rows(archive_changes(df))] == [(2, "a", "changed"), (3, "a", "changed")]


def test_empty_single_and_null_keys(spark):
    assert rows(archive_changes(sources(spark, []))) == []
    assert rows(archive_changes(sources(spark, [(1, 0, "a", "1", None)]))) == []
    df = sources(spark, [(1, 0, None, "1", None), (2, 0, "a", "1", None)])
    assert rows(archive_changes(df)) == []
    df = spark.createDataFrame([(None, "a", "1"), (1, "b", "1"), (2, "b", "2")], "snapshot_no int, path string, f string")
    assert rows(changes(df, "snapshot_no", "path", ["f"])) == [(2, "b", "changed", ("f",))]


def test_hot_path_and_brute_force(spark):
    import random

    rng = random.Random(5)
    data = [(s, rng.randrange(9), rng.choice(["hot"] * 5 + [f"p{i}" for i in range(20)]), rng.choice(["1", "2", None]), None) for s in (1, 2, 4, 7) for _ in range(60)]
    got = [r[:3] for r in rows(archive_changes(sources(spark, data)))]
    state = {}
    for s, h, p, c, _ in data:
        best = state.setdefault(s, {}).get(p)
        if best is None or (h, c is not None, c or "") > best:
            state[s][p] = (h, c is not None, c or "")
    want = []
    for before, after in zip(sorted(state), sorted(state)[1:]):
        for p in state[before].keys() | state[after].keys():
            x, y = state[before].get(p), state[after].get(p)
            if x is None or y is None or x[1:] != y[1:]:
                want.append((after, p, "added" if x is None else "deleted" if y is None else "changed"))
    assert got == sorted(want)
