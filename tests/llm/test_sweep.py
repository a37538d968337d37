from collections import defaultdict
from datetime import datetime

from graphloom.llm import sweep

SPANS = "key int, start long, end long, value long"


def plain(spans):
    """The rows of a sweep, moment by moment."""
    moved = defaultdict(lambda: defaultdict(lambda: [0, 0]))
    for key, start, end, value in spans:
        if key is None or start is None or end is not None and end <= start:
            continue
        for at, sign in ((start, 1), (end, -1)):
            if at is not None:
                moved[key][at][0] += sign
                moved[key][at][1] += sign * (value or 0)
    out = []
    for key, moments in moved.items():
        rows, n, v, high = [], 0, 0, None
        for at in sorted(t for t, (dn, dv) in moments.items() if dn or dv):
            n, v = n + moments[at][0], v + moments[at][1]
            high = n if high is None else max(high, n)
            rows.append([at, n, v, high])
        top = max((r[2] for r in rows), default=0)
        for r, later in zip(rows, [*rows[1:], None]):
            out.append((key, r[0], later and later[0], *r[1:], r[2] == top))
    return sorted(out, key=str)


def swept(spark, spans):
    return sorted((tuple(r) for r in sweep.sweep(spark.createDataFrame(spans, SPANS)).collect()), key=str)


def test_equals_plain_over_many_blocks_and_partitions(spark, rng):
    spans = [(rng.choice([1, 1, 1, 1, 2, 3, -1]), a := rng.randrange(60_000), None if rng.random() < 0.1 else a + rng.randrange(-5, 9000), rng.randrange(-50, 900)) for _ in range(12_000)]
    assert swept(spark, spans) == plain(spans)


def test_ties_repeats_nulls_and_changes_that_cancel(spark):
    spans = [(1, 10, 20, 5)] * 3 + [(1, 20, 30, 5)] * 3 + [(1, 20, 20, 9), (1, 25, 24, 9), (None, 1, 2, 3), (2, None, 5, 1), (2, 7, None, None), (3, -5, -1, -4)]
    assert swept(spark, spans) == plain(spans)
    assert [r[1] for r in plain(spans) if r[0] == 1] == [10, 30]


def test_empty(spark):
    assert swept(spark, []) == []


def test_columns_that_clash_are_left_out(spark):
    df = spark.createDataFrame([(1, 1, 4, 2, 9, 9)], SPANS + ", at long, n long")
    assert [tuple(r) for r in sweep.sweep(df).collect()] == [(1, 1, 4, 1, 2, 1, True), (1, 4, None, 0, 0, 1, False)]


def test_sales(spark):
    day = lambda d, *t: datetime(2024, 1, d, *t)
    sales = spark.createDataFrame(
        [(1, 7, 1.005, day(1)), (2, 7, None, day(2)), (3, None, 2.0, day(2)), (4, 99, 3.0, None), (5, 8, 4.0, day(9)), (None, 8, 1.0, day(3, 0, 0, 0, 900_000)), (1, 7, 1.005, day(1))],
        "sale_id long, client_id long, total double, sold_at timestamp_ntz",
    )
    lines = spark.createDataFrame([(1, day(5)), (1, day(4)), (1, None), (2, None), (5, day(3)), (None, day(1))], "sale_id long, shipped_at timestamp_ntz")
    clients = spark.createDataFrame([(7, 3), (7, 3), (8, None), (9, 1)], "client_id long, nation_id int")
    rows = {(r.key, r.start, r.end, r.value): 0 for r in sweep.open_sales(sales, lines, clients).collect()}
    s = lambda d: 1704067200 + (d - 1) * 86_400
    of = {(3, s(1), s(5), 100), (3, s(2), None, 0), (-1, s(2), None, 200), (-1, s(3), None, 100)}
    assert set(rows) == of | {(-2, *x[1:]) for x in of}
    found = {(r.key, r.from_s): r.n_open for r in sweep.sweep(sweep.open_sales(sales, lines, clients)).collect()}
    assert found[3, s(1)] == 2 and found[3, s(2)] == 3 and found[3, s(5)] == 1 and found[-2, s(3)] == 5
