"""Turning points and events on small series, with what each bar should be worked out by hand or by a plain loop."""

import datetime
import random

import pytest

from tidemark.operators import patterns as pat
from tidemark.operators.rolling import Series

S = Series()


def frame(spark, closes, stock="X"):
    day = datetime.datetime(2024, 1, 1)
    rows = [(stock, day + datetime.timedelta(days=i), float(c), c + 1.0, c - 1.0, float(c), 1000) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "stock_id string, date timestamp_ntz, open double, high double, low double, close double, volume bigint")


def columns(df, *names):
    rows = df.orderBy("date").collect()
    return [[r[n] for r in rows] for n in names]


def walk(seed, n):
    r = random.Random(seed)
    out, level = [], 50.0
    for _ in range(n):
        level = max(5.0, level + r.choice([-3, -1, -0.2, 0, 0.2, 1, 3]))
        out.append(round(level, 2))
    return out


def plain_events(closes, left, right, tolerance=0.01):
    """(label, base, event, offset) by a loop over bars."""
    n = len(closes)
    base = [int(i >= left and i + right < n and closes[i] < min(closes[i - left : i]) and closes[i] < min(closes[i + 1 : i + 1 + right])) for i in range(n)]
    number, seen = [0] * n, 0
    for i in range(n):
        seen += base[i]
        number[i] = seen
    event, offset = [0] * n, [None] * n
    for i in range(n):
        if base[i]:
            event[i], offset[i] = number[i], 0.0
            continue
        able = [j for j in (i - 1, i + 1) if 0 <= j < n and base[j] and abs(closes[i] - closes[j]) / closes[j] <= tolerance]
        if able:
            j = min(able, key=lambda j: (closes[j], j))
            event[i], offset[i] = number[j], float(i - j)
    return [int(e > 0) for e in event], base, event, offset


@pytest.mark.parametrize(("seed", "left", "right"), [(1, 1, 1), (2, 2, 1), (3, 2, 3), (4, 3, 3)])
def test_events_against_a_plain_loop(spark, seed, left, right):
    closes = walk(seed, 90)
    got = columns(pat.events(frame(spark, closes), S, left, right), pat.LABEL, pat.BASE, pat.EVENT, pat.OFFSET)
    want = plain_events(closes, left, right)
    assert [list(x) for x in got] == [list(x) for x in want] and sum(want[1]) > 2


def test_missing_columns_are_rebuilt(spark):
    full = pat.events(frame(spark, walk(7, 120)), S)
    names = (pat.LABEL, pat.BASE, pat.EVENT, pat.OFFSET)
    for gone in ((pat.EVENT, pat.OFFSET), (pat.BASE,), names):
        assert columns(full, *names) == columns(pat.ensure_events(full.drop(*gone), S), *names)
    assert pat.ensure_events(full, S) is full


def test_equal_lows_are_local_lows_and_no_pivots(spark):
    df = frame(spark, [60, 58, 55, 55, 57, 61])
    assert columns(pat.pivots(df, S, 1, 1), "pivot_low")[0] == [0] * 6
    assert columns(df.withColumn("l", pat.local_low(S, "close", 2)), "l")[0] == [0, 1, 1, 1, 0, 0]


def test_ends_of_a_series_are_no_pivots(spark):
    flags = pat.pivots(frame(spark, [20, 22, 30, 24, 19]), S, 1, 1)
    assert columns(flags, "pivot_low", "pivot_high") == [[0] * 5, [0, 0, 1, 0, 0]]
    values = pat.pivots(frame(spark, [40, 33, 38, 47, 41]), S, 1, 1, values=True)
    assert columns(values, "pivot_low", "pivot_high") == [[None, 33.0, None, None, None], [None, None, None, 47.0, None]]


def test_support_tests_against_a_plain_loop(spark):
    closes = walk(11, 80)
    low = [int(i >= 2 and closes[i] == min(closes[i - 2 : i + 1])) for i in range(80)]
    df = frame(spark, closes).withColumn("LocalLow", pat.local_low(S, "close", 3))
    want = [sum(low[j] and abs(closes[j] - closes[i]) / closes[i] < 0.02 for j in range(i)) for i in range(80)]
    assert columns(pat.support_tests(df, S), "support_test_count")[0] == want and max(want) > 3


@pytest.mark.parametrize("other", [0, 1])
def test_other_series_change_nothing(spark, other):
    closes = walk(21, 60)
    df = frame(spark, closes)
    df = df.unionByName(frame(spark, walk(22, 60), "Y")) if other else df
    out = pat.events(df, S, 2, 2).where("stock_id = 'X'")
    assert columns(out, pat.EVENT)[0] == plain_events(closes, 2, 2)[2]
