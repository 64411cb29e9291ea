"""Every registered query of the subpackage runs on the smallest tables, and equals its SQL where it has one; the others
keep what their results promise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import queries, tokens
from lectern.llm.texts import chunk_texts
from lectern.sources.tables import table
from tests.oracle import differences

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_sql(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.ORACLES[name], FOLDER) == ([], [])


def test_pieces(spark):
    rows = queries.p1_pieces(spark, FOLDER).collect()
    texts = {r.rowid: r.text for r in chunk_texts(spark, FOLDER).collect()}
    assert rows and {r.rowid for r in rows} == {k for k, t in texts.items() if len(t) > 3500} and max(len(r.piece_text) for r in rows) <= 3500
    assert all(r.piece_text == texts[r.rowid][r.piece_start : r.piece_end] for r in rows)


def test_scanned_pages(spark):
    scanned = {r.rowid for r in chunk_texts(spark, FOLDER, "extraction_method").filter(F.col("extraction_method").contains("ocr")).collect()}
    found = queries.p2_found(spark, FOLDER).collect()
    assert {r.rowid for r in queries.p2_pages(spark, FOLDER).select("rowid").collect()} == scanned
    assert {r.rowid for r in found} <= scanned and {r.defect for r in found} <= {"hyphenation", "misread", "header", "page_number"} and len(found) > 50
    assert len(set(found)) == len(found)


def test_neighbours(spark):
    rows = {}
    for r in table(spark, FOLDER, "vectors").collect():
        v = np.array(r.vector if r.vector is not None and None not in r.vector else [], dtype=np.float64)
        if r.key is not None and len(v) == 384 and np.isfinite(v).all() and v.any():
            rows[r.key] = v / np.linalg.norm(v)
    keys, matrix = list(rows), np.stack(list(rows.values()))
    like = matrix @ matrix.T
    np.fill_diagonal(like, -2)
    true = {(min(keys[i], keys[j]), max(keys[i], keys[j])) for i, near in enumerate(np.argsort(-like, axis=1)[:, :10]) for j in near}
    got = {(r.key_a, r.key_b) for r in queries.p3_found(spark, FOLDER).collect()}
    assert len(true & got) >= 0.97 * max(len(true), len(got))
    ranked = queries.p3_neighbours(spark, FOLDER).collect()
    assert len(ranked) == 10 * len(keys) and {r["rank"] for r in ranked} == set(range(1, 11))
    assert all(1 <= r["rank"] <= 10 for r in queries.p3_search(spark, FOLDER).collect())


def test_packing_and_mixing(spark):
    sizes = {r.doc_id: r.tokens for r in tokens.sized(table(spark, FOLDER, "documents"), "doc_id", tokens.default_vocabulary(spark)).collect()}
    budgets = queries._budgets(spark, FOLDER)
    placed = queries.p6_containers(spark, FOLDER)
    held = {(r.budget_id, r.doc_id): r.n for r in placed.groupBy("budget_id", "doc_id").agg(F.sum("tokens").alias("n")).collect()}
    assert held == {(b, d): n for b, _, _ in budgets for d, n in sizes.items()}
    for budget, capacity, separator in budgets:
        full = placed.filter(F.col("budget_id") == budget).groupBy("container").agg((F.sum("tokens") + separator * F.count("*")).alias("n"))
        assert full.agg(F.max("n")).first()[0] <= capacity
    assert all(0 < r.filled <= 1 and r.containers >= r.fewest_containers for r in queries.p6_fill(spark, FOLDER).collect())
    most = {(r.mix_id, r.source): r.max_repeats for r in queries.p7_shares(spark, FOLDER).collect()}
    records = queries.p7_records(spark, FOLDER).collect()
    assert records and all(1 <= r.copies <= most[r.mix_id, r.source] and r.tokens == sizes[r.doc_id] for r in records)
