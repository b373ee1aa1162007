"""Vectors by context: what the queries shuffle of them, and the sentence-aware buffers over many blocks of samples."""

import datetime
import os
import random
from dataclasses import replace

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_entry import rows
from test_expand import SCHEMA, elements, got, model

import __spark_entry__ as entry
from lagfield.operators.expand import Buffer, queue_parse_reset, stack_parse_reset, sym_parse_reset

N = 1200


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """Two hours of one recording that hold N events, and one event in each of the others of a day."""
    rng, start = random.Random(7), datetime.datetime(2024, 1, 1)
    seconds = sorted([rng.uniform(0, 7200) for _ in range(N)] + [3600 * h + 1800 for h in range(2, 24)])
    n = len(seconds)
    table = {"event_id": range(n), "ts": [start + datetime.timedelta(seconds=s) for s in seconds], "user_id": [4] * n, "event_type": ["view"] * n, "value": [round(rng.uniform(0, 99), 2) for _ in range(n)], "props": [f'{{"k": {rng.randint(1, 99)}}}' for _ in range(n)]}
    at = tmp_path_factory.mktemp("crowded")
    pq.write_table(pa.table({k: pa.array(list(v)) for k, v in table.items()}), at / "events.parquet")
    return str(at)


def shuffled(spark) -> int:
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    tasks = sc.statusStore().executorList(True)
    return sum(tasks.apply(i).totalShuffleWrite() for i in range(tasks.size()))


@pytest.mark.parametrize("name", ["mixed_design", "queue_parse_reset", "queue_parse_reset_legacy", "stack_parse_reset", "sym_parse_reset"])
def test_rows_do_not_grow_with_their_sentence(spark, crowded, name):
    """Shuffled bytes are in proportion to the events, of which a sentence has hundreds."""
    df, before = entry.queries()[name](spark, crowded), shuffled(spark)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    assert shuffled(spark) - before < 400 * N
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{os.path.join(crowded, 'events.parquet')}'")
    rel = con.sql(entry.oracle_sql()[name])
    assert found == rows(rel.columns, rel.fetchall())


def test_blocks_equal_push_and_pop(spark):
    """180 samples are eight blocks of 24; windows cross their borders, and those before an element lie far from those after it."""
    rng = random.Random(3)
    times = sorted(rng.uniform(-0.5, 61) for _ in range(200))
    sentences = [i // 4 for i in range(200)]
    plain = [(t, s, sentences[:i].count(s), [[float(i + 1000 * c)] for c in range(6)]) for i, (t, s) in enumerate(zip(times, sentences, strict=True))]
    b = Buffer(frequency=3, duration=60, dim=1, prediction_start=-0.4, prediction_end=1.3, nb_buffer=3, buffer_duration=20.0)
    table = spark.createDataFrame([(0, i, *r) for i, r in enumerate(plain)], SCHEMA.replace("array<double>", "array<array<double>>"))
    stack, queue = model(plain, b, True, True), model(plain, b, False, True)
    assert got(stack_parse_reset(table, b)) == stack
    assert got(queue_parse_reset(table, b)) == queue
    assert len({t // 24 for t, _ in stack}) == 8
    made = replace(b, in_context=lambda vec, c: F.array(vec[0] + 1000 * c))
    narrow = elements(spark, [(t, s, p, v[0]) for t, s, p, v in plain])
    assert got(stack_parse_reset(narrow, made)) == stack
    assert got(queue_parse_reset(narrow, made, legacy_overflow=True)) == model(plain, b, False, True, legacy=True)
    earlier = replace(b, prediction_start=-20.4, prediction_end=-18.7)
    past = model(plain, earlier, False, True)
    assert got(sym_parse_reset(narrow, made)) == past | {(t, s + 3): v for (t, s), v in stack.items()}


def test_a_null_sentence_clears_nothing(spark):
    b = Buffer(frequency=1, duration=4, dim=1, prediction_end=4, nb_buffer=9, in_context=lambda vec, c: vec)
    table = elements(spark, [(0.0, 1, 0, [1.0]), (0.0, 2, 0, [2.0]), (0.0, None, 0, [4.0]), (0.0, 3, 0, [8.0])])
    assert {k: v for k, v in got(queue_parse_reset(table, b)).items() if k[0] == 0} == {(0, 0): [2.0], (0, 1): [4.0], (0, 2): [8.0]}
