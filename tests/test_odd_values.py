"""Queries against their SQL on small event tables with odd values."""

import duckdb

from sessionweave.plans import catalog


def both(spark, tmp_path, name, rows):
    """Rows of the query and of its SQL; rows: (event_id, seconds, user_id, event_type, value as SQL)."""
    con = duckdb.connect().cursor()
    values = ", ".join(f"({i}, TIMESTAMP '2024-01-01' + INTERVAL ({round(t * 1e6)}) MICROSECOND, {s}, '{kind}', {v}::DOUBLE, '{{\"k\": 1}}')" for i, t, s, kind, v in rows)
    con.sql(f"CREATE TABLE events AS SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value, props FROM (VALUES {values}) AS t(event_id, ts, user_id, event_type, value, props)")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    df, sql = catalog.queries()[name](spark, str(tmp_path)), con.sql(catalog.oracle_sql()[name])
    return sorted(repr(tuple(r[c] for c in sql.columns)) for r in df.collect()), sorted(map(repr, sql.fetchall()))


def test_practice_effect_from_zero(spark, tmp_path):
    first_second = [("0", "5"), ("0", "0"), ("0", "-5"), ("'-0.0'", "5"), ("0", "NULL"), ("NULL", "0"), ("4", "0"), ("0", "'nan'"), ("4", "3"), ("0", "'inf'")]
    got, want = both(spark, tmp_path, "practice_effect", [(2 * s + k, k, s, "purchase", v) for s, pair in enumerate(first_second) for k, v in enumerate(pair)])
    assert got == want and len(got) == len(first_second)


def test_epoch_metrics_halves_ties_nulls(spark, tmp_path):
    rows = []

    def session(s, at, around):
        rows.append((100 * s, 0, s, "click", 1))
        rows.extend((100 * s + k, at + x, s, "purchase" if x == 0 else "view", v) for k, (x, v) in enumerate(around, 1))

    session(1, 448006.5774, [(-20, 3), (-10, 5), (0, 4), (900.09865, 90.25), (1000, 7)])  # a latency that ends in a half
    session(2, 300_000, [(-20, 3), (-10, 5), (0, 4), (40, 90.25), (90, 90.25), (120, 1)])  # two equal peaks
    session(3, 300_000, [(-20, 3), (-10, 5), (0, "NULL"), (40, "NULL"), (90, "NULL")])  # no value from the event on
    session(4, 300_000, [(-20, 0), (-10, 0), (0, 22.4), (90_000, -0.63), (90_010, 0), (90_020, -0.315)])
    got, want = both(spark, tmp_path, "epoch_metrics", rows)
    assert got == want and len(got) == 4


def test_epoch_metrics_keeps_the_sign_of_zero(spark, tmp_path):
    around = [(-20, 3), (-10, 5), (0, 4.5), (40, 90), (90_000, 3.9999999)]  # a mean after the peak that rounds to zero from below
    rows = [(0, 0, 1, "click", 1), *((k, 300_000 + x, 1, "purchase" if x == 0 else "view", v) for k, (x, v) in enumerate(around, 1))]
    got, want = both(spark, tmp_path, "epoch_metrics", rows)
    assert got == want and len(got) == 1 and "-0.0" in got[0]


def test_log_bins_at_zero_and_below(spark, tmp_path):
    values = ["0", "'-0.0'", "0.01", "0.1", "1", "1000", "1001", "NULL"]
    got, want = both(spark, tmp_path, "log_bins", [(k, k, 1, "view", v) for k, v in enumerate(values)])
    assert got == want and any("-inf" in r for r in got)
    got, want = both(spark, tmp_path, "log_bins", [(k, k, 1, "view", v) for k, v in enumerate([*values, "-5"])])
    assert got == want and any("nan" in r for r in got)
