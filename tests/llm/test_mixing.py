import random
from collections import defaultdict

from lectern.llm.mixing import mix, normal_source, plan, ranked, shares
from pyspark.sql import functions as F

TARGETS = "mix_id string, source string, target_weight double, max_repeats int, budget_ratio double"


def run(spark, rows, targets):
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long").withColumn("source", normal_source(F.col("source")))
    ranks = ranked(df, "doc_id")
    planned = plan(ranks.filter("source is not null"), spark.createDataFrame(targets, TARGETS), sum(t for *_, t in rows))
    mixed = mix(ranks, planned, "doc_id")
    return df, ranks, mixed, {(r.mix_id, r.source): r for r in shares(planned, mixed).collect()}


def test_ranks_and_shares(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "A ", "b", "b", "b", None]), rng.randrange(1, 400)) for i in range(3000)]
    targets = [("m", "A", 3.0, 2, 0.2), ("m", "B", 1.0, None, 0.2), ("m", "gone", 1.0, 5, 0.2), ("n", "a", 1.0, 3, 5.0)]
    df, ranks, mixed, out = run(spark, rows, targets)
    by = defaultdict(list)
    for r in ranks.collect():
        by[r.source].append((r.rank, r.tokens, r.doc_id))
    assert sum(map(len, by.values())) == len(rows) and None in by
    for own in by.values():
        own.sort()
        assert [r for r, *_ in own] == list(range(1, len(own) + 1)) and [x[1:] for x in own] == sorted(x[1:] for x in own)
    total = sum(t for *_, t in rows)
    a, b, gone, n = (out[k] for k in (("m", "A"), ("m", "B"), ("m", "GONE"), ("n", "A")))
    assert abs(a.mixed_tokens - 0.6 * 0.2 * total) < 800 and abs(b.mixed_tokens - 0.2 * 0.2 * total) < 800
    assert gone.mixed_tokens == 0 and gone.real_share == 0 and abs(a.real_share + b.real_share - 1) < 1e-5
    assert n.most_copies == 3 and n.mixed_copies == 3 * n.source_records and n.exhausted
    for r in mixed.collect():
        assert 1 <= r.copies <= {("m", "A"): 2, ("m", "B"): 1, ("n", "A"): 3}[r.mix_id, r.source]


def test_same_whatever_the_partitions(spark):
    rows = [(i, "a", i % 7 + 1) for i in range(500)]
    one = run(spark, rows, [("m", "a", 1.0, 1, 0.3)])[2].collect()
    other = run(spark, list(reversed(rows)), [("m", "a", 1.0, 1, 0.3)])[2].repartition(3).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, other)) and one


def test_edges(spark):
    assert run(spark, [], [("m", "a", 1.0, 1, 0.5)])[3]["m", "A"].mixed_tokens == 0
    assert run(spark, [(1, "a", 5)], [])[3] == {}
    out = run(spark, [(1, "a", 5), (1, "a", 5), (None, "a", 5)], [("m", "a", None, None, 0.5), ("m", None, 1.0, 1, 0.5), ("k", "a", 0.0, 0, 0.5)])[3]
    assert {k: r.mixed_tokens for k, r in out.items()} == {("m", "A"): 0, ("k", "A"): 0}
