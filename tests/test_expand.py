"""Golden micro-fixtures and a push/pop model for the buffers."""

import random

import pytest

from lagfield.operators.expand import BUFFERS, Buffer, drop_empty_slots, queue_buffer, queue_parse_reset, reverse_tap_add, stack_buffer, stack_parse_reset, sym_tap, sym_timeshift, tap_add

SCHEMA = "recording int, element_id long, t double, sentence_id int, position int, vec array<double>"


def elements(spark, rows):
    return spark.createDataFrame([(0, i, t, s, p, v) for i, (t, s, p, v) in enumerate(rows)], SCHEMA)


def plain(spark, *at):
    return elements(spark, [(t, 0, i, [float(i + 1)]) for i, t in enumerate(at)])


def got(design):
    return {(r.t_idx, r.slot): list(r.vec) for r in design.collect()}


B = Buffer(frequency=20, duration=0.5, dim=1, nb_buffer=3)


def test_coincident_taps_add_up(spark):
    assert got(tap_add(plain(spark, 0.1, 0.12), B)) == {(2, 0): [3.0], (3, 1): [3.0], (4, 2): [3.0]}


def test_wide_taps(spark):
    wide = Buffer(frequency=20, duration=0.5, dim=1, period=0.1, nb_buffer=2)
    assert got(tap_add(plain(spark, 0.1, 0.15), wide)) == {(2, 0): [1.0], (3, 0): [3.0], (4, 0): [2.0], (4, 1): [1.0], (5, 1): [3.0], (6, 1): [2.0]}


def test_taps_leave_the_grid_without_wrapping(spark):
    assert got(tap_add(plain(spark, 0.45), B)) == {(9, 0): [1.0]}
    assert got(reverse_tap_add(plain(spark, 0.1), B)) == {(0, 1): [1.0], (1, 2): [1.0]}  # s0 = trunc(-1.0)
    assert got(drop_empty_slots(reverse_tap_add(plain(spark, 0.1), B))) == {(0, 0): [1.0], (1, 1): [1.0]}


def test_past_slots_come_first(spark):
    assert sorted(got(sym_tap(plain(spark, 0.26), B))) == [(2, 0), (3, 1), (4, 2), (5, 3), (6, 4), (7, 5)]


def test_overflow_adds_into_the_last_slot(spark):
    two = Buffer(frequency=1, duration=4, dim=1, prediction_end=9, nb_buffer=2)
    four = plain(spark, 3.0, 3.0, 3.0, 3.0)
    assert got(stack_buffer(four, two)) == {(3, 0): [4.0], (3, 1): [6.0]}
    assert got(queue_buffer(four, two)) == {(3, 0): [1.0], (3, 1): [9.0]}


def test_windows_are_clamped(spark):
    b = Buffer(frequency=1, duration=4, dim=1, prediction_end=2, nb_buffer=2)
    assert got(stack_buffer(plain(spark, -1.0, 9.0), b)) == {(0, 0): [1.0], (3, 0): [2.0]}  # one that starts after the end meets the last sample


def test_null_and_nan_elements_are_dropped(spark):
    rows = elements(spark, [(0.1, 0, 0, [1.0]), (0.1, 0, 1, [float("nan")]), (0.1, 0, 2, None), (0.1, 0, 3, [None])])
    assert got(tap_add(rows, B))[(2, 0)] == [1.0]
    assert got(stack_buffer(rows, B))[(2, 0)] == [1.0]


def test_shifts(spark):
    series = spark.createDataFrame([(0, t, [float(t)]) for t in range(6)], "recording int, t_idx int, vec array<double>")
    b = Buffer(frequency=1, duration=6, dim=1, prediction_start=0, period=2, nb_buffer=2)
    out = got(sym_timeshift(series, b))
    assert {t for t, s in out if s == 1} == {0, 1, 2, 3} and out[(0, 1)] == [2.0]  # past lag of 2
    assert {t for t, s in out if s == 3} == {2, 3, 4, 5} and out[(5, 3)] == [3.0]
    zero = got(BUFFERS["lazy_timeshift"](series, b))
    assert len(zero) == 24 and zero[(0, 3)] == [0.0]


def test_single_tap_needs_one_sample_to_a_period(spark):
    with pytest.raises(ValueError):
        BUFFERS["tap"](plain(spark, 0.1), Buffer(frequency=20, duration=1, dim=1, period=0.1))


def model(rows, b, newest, reset, legacy=False):
    """Push and pop, sample by sample."""
    out = {}
    for s in range(b.n):
        held = []
        for i, (t, sentence, position, vec) in enumerate(rows):
            lo, hi = max(0, min(int((t + b.prediction_start) * b.frequency), b.n - 1)), min(int((t + b.prediction_end) * b.frequency), b.n)
            if lo <= s < hi:
                if reset and held and held[-1][1] != sentence:
                    held = []
                held.append((i, sentence, position, vec))
        context = max((h[2] for h in held), default=0)
        for rank, h in enumerate(held[::-1] if newest else held):
            c = len(held) - 1 if legacy and rank >= b.nb_buffer else context
            v = h[3][c][0] if reset else h[3][0]
            key = s, min(rank, b.nb_buffer - 1)
            out[key] = [out.get(key, [0.0])[0] + v]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_buffers_equal_push_and_pop(spark, seed):
    rng = random.Random(seed)
    times = sorted(rng.uniform(-0.5, 6.5) for _ in range(25))
    rows, n = [], 0
    for i, t in enumerate(times):
        if i and rng.random() < 0.3:
            n += 1
        rows.append((t, n, sum(r[1] == n for r in rows), [float(rng.randint(1, 99))]))
    b = Buffer(frequency=3, duration=6, dim=1, prediction_start=-0.4, prediction_end=1.3, nb_buffer=3)
    assert got(stack_buffer(elements(spark, rows), b)) == model(rows, b, True, False)
    assert got(queue_buffer(elements(spark, rows), b)) == model(rows, b, False, False)
    deep = [(t, s, p, [[v[0] + 100 * c] for c in range(25)]) for t, s, p, v in rows]
    table = spark.createDataFrame([(0, i, *r) for i, r in enumerate(deep)], SCHEMA.replace("array<double>", "array<array<double>>"))
    assert got(stack_parse_reset(table, b)) == model(deep, b, True, True)
    assert got(queue_parse_reset(table, b)) == model(deep, b, False, True)
    assert got(queue_parse_reset(table, b, legacy_overflow=True)) == model(deep, b, False, True, legacy=True)


def test_buffer_plans_have_no_join(spark):
    for f in (stack_buffer, queue_buffer):
        plan = f(plain(spark, 0.1), B)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Cartesian" not in plan and plan.count("Exchange hashpartitioning") == 1
