import hashlib
import math

import numpy as np
import pytest
from cases import SF_DIR
from oracle_check import compare, connect

from dialwise.llm import vector_codes as vc
from dialwise.llm.queries import ORACLE, QUERIES

ROWS = "vec_id long, embedding array<double>, label int, position string, entry string, row string, error int"


def by_hand(rows, positions=8, entries=16, rounds=6):
    """Rows (vec_id, vector, label) to (vec_id, code, error, label_error, digest), in whole numbers of
    Python, as the rule is written."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1]) // positions
    parts = [
        [[math.floor(4096 * x) for x in v[p * width : (p + 1) * width]] for p in range(positions)]
        for _, v, _ in kept
    ]
    books = [[list(v[p]) for v in parts[:entries]] for p in range(positions)]

    def nearest(part, book):
        return min((sum((x - c) ** 2 for x, c in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            homes = [nearest(v[p], book)[1] for v in parts]
            for e in range(len(book)):
                own = [v[p] for v, home in zip(parts, homes) if home == e]
                if own:
                    book[e] = [sum(x) // len(own) for x in zip(*own)]
    last = [[nearest(v[p], books[p]) for p in range(positions)] for v in parts]
    errors = [sum(d for d, _ in found) for found in last]
    totals = {}
    for (_, _, label), error in zip(kept, errors):
        totals[label] = totals.get(label, 0) + error
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return sorted(
        [
            (i, "".join(f"{e:02x}" for _, e in found), error, totals[label], digest)
            for (i, _, label), found, error in zip(kept, last, errors)
        ],
        key=repr,
    )


def found(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 7) for r in rows], ROWS)


def test_query_matches_duckdb(spark):
    query = QUERIES["op12_vector_codes"](spark, SF_DIR)
    assert query.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert compare(connect(SF_DIR), ORACLE["op12_vector_codes"], query) is None


def test_a_common_vector_ties_and_unused_entries(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [0.25] * 16, i % 3) for i in range(40)]
    rows += [(100 + i, rng.integers(-3, 4, 16).astype(float).tolist(), None) for i in range(300)]
    rows += [(1000 + i, rng.normal(size=16).tolist(), 9) for i in range(200)]
    assert found(vc.code_table(table(spark, rows).repartition(7))) == by_hand(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=8).tolist(), i % 2) for i in range(60)]
    good += [(5, [-0.0001] * 8, None), (5, [-0.0001] * 8, None), (None, [9.0] * 8, None)]
    bad = [
        (1, None, 1), (2, [nan] * 8, 1), (3, [1.0] * 7 + [inf], 1), (4, [1.0] * 7 + [None], 1), (6, [], 1),
    ]
    assert found(vc.code_table(table(spark, good + bad))) == by_hand(good)
    # Vectors of another length, or beyond what 64 bits hold, take no part.
    more = [(-9, [1.0] * 24, 1), (-8, [1.0] * 7, 1), (-7, [1e30] * 8, 1)]
    assert found(vc.code_table(table(spark, good + more))) == by_hand(good)


def test_fewer_rows_than_entries_and_none(spark):
    few = [(i, [float(i)] * 8, None) for i in range(5)]
    assert found(vc.code_table(table(spark, few))) == by_hand(few)
    assert vc.code_table(table(spark, few).limit(0)).count() == 0
    assert vc.code_table(table(spark, [(1, None, None), (2, [float("nan")], 1)])).count() == 0


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=8) * 10.0 ** rng.integers(0, 5)).tolist(), 1) for i in range(80)]
    assert found(vc.code_table(table(spark, rows))) == by_hand(rows)


@pytest.mark.parametrize("scale", [1, 1 << 24, 1 << 36])
def test_nearest_entry_is_exact_and_the_first_of_equals(scale):
    rng = np.random.default_rng(1)
    parts, entries = (rng.integers(-50, 50, (n, 6)) * scale + 1 for n in (200, 9))
    entries[4] = entries[2]
    at, away = vc.nearest(parts, entries)
    for part, i, d in zip(parts.tolist(), at.tolist(), away.tolist()):
        assert (d, i) == min(
            (sum((x - c) ** 2 for x, c in zip(part, e)), k) for k, e in enumerate(entries.tolist())
        )


def test_only_parts_that_change_their_entry_move(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16).tolist(), 0) for i in range(500)]
    moved = []
    real = vc.frozen
    try:
        vc.frozen = lambda df, stem: moved.append((stem, real(df, stem))) or moved[-1][1]
        whole, books = vc.vector_codes(table(spark, rows), rounds=4)
        assert whole.count() == 500 and books.shape == (8, 16, 2)
    finally:
        vc.frozen = real
    assert [stem for stem, _ in moved] == ["vectors", "residents", "arrivals", "arrivals", "arrivals"]
    parts = moved[1][1]
    assert parts.count() == 8 * 500
    arrivals = [t.where("row >= 0") for _, t in moved[2:]]
    before = parts.selectExpr("row", "position", "entry AS was")
    for now in arrivals:
        both = now.join(before, ["row", "position"])
        assert 0 < now.count() < 2000 and both.where("was = entry").count() == 0
        before = before.join(now.selectExpr("row", "position", "entry AS now"), ["row", "position"], "left")
        before = before.selectExpr("row", "position", "coalesce(now, was) AS was")
