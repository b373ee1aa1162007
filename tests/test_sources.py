"""Readers, writers, transcripts and channels on small files."""

import pytest

from lagfield.functions import channels, transcript
from lagfield.functions.grid import position_in_sentence, time_grid
from lagfield.sources import tables


def test_transcript(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("row_id\tword\tstart\tend\tpos\tsentence_id\n0\tDon't\t0.5\t0.75\tv\t0\n1\t.\t0.9\t0.9\tpunct\t0\n2\tGo\t1.0\t1.5\t\t0\n3\tgo\t1.0\t1.25\tv\t1\n")
    words = tables.read_transcript(spark, str(path))
    kept = transcript.normalize_transcript(words).orderBy("row_id").collect()
    assert [(r.text, r.duration, r.type) for r in kept] == [("dont", 0.25, "Word"), ("go", 0.5, "Word"), ("go", 0.25, "Word")]
    from pyspark.sql import functions as F

    timed = words.withColumn("recording", F.lit(0))
    assert [r.row_id for r in transcript.drop_split_words(timed).orderBy("row_id").collect()] == [0, 1, 2]
    assert [r.position for r in position_in_sentence(timed).orderBy("row_id").collect()] == [0, 1, 2, 0]
    both = transcript.union_events(words.select("word"), spark.createDataFrame([("a.wav",)], "filepath string"))
    assert both.count() == 5 and both.where("word IS NULL").first().filepath == "a.wav"


def test_readers_find_columns_by_name(spark, tmp_path):
    """The columns of transcripts and electrodes as they are published: no row numbers, another order, cells missing, and rows that do not fit kept apart."""
    folder = tmp_path / "words"
    folder.mkdir()
    (folder / "a.tsv").write_text("start\tword\tend\tspeaker\tpos\tsentence_id\n0.5\tDon't\t0.75\tu\tv\t0\nx\tbad\t1\tu\tv\t0\n1\tfew\n1.0\tGo\t1.5\tu\t\tn/a\n1.0\tmore\t1.5\tu\tv\t0\tz\n")
    (folder / "b.tsv").write_text("start\tword\tend\tspeaker\tpos\tsentence_id\n9\tlast\t9.5\tu\tv\t3\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")  # a file in several blocks
    try:
        found = tables.read_transcript(spark, str(folder), malformed=True).orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.row_id, r.word, r.malformed is None) for r in found] == [(0, "Don't", True), (1, "bad", False), (2, "few", False), (3, "Go", True), (4, "more", False), (5, "last", True)]
    assert found[1].malformed == "x\tbad\t1\tu\tv\t0" and (found[3].start, found[3].end, found[3].pos, found[3].sentence_id) == (1.0, 1.5, None, None)
    assert [tuple(r) for r in tables.read_transcript(spark, str(folder)).orderBy("row_id").collect()] == [(0, "Don't", 0.5, 0.75, "v", 0), (3, "Go", 1.0, 1.5, None, None), (5, "last", 9.0, 9.5, "v", 3)]
    (tmp_path / "e.tsv").write_text("name\tx\ty\tz\nG1\t1\t2\t3\nG2\tn/a\tn/a\tn/a\n")
    assert [tuple(r) for r in tables.read_electrodes(spark, str(tmp_path / "e.tsv")).collect()] == [(None, "G1", 1.0, 2.0, 3.0), (None, "G2", None, None, None)]
    (tmp_path / "c.tsv").write_text("status\tname\nbad\tG2\ngood\tG1\n")
    assert [tuple(r) for r in tables.read_channels(spark, str(tmp_path / "c.tsv")).orderBy("ord").collect()] == [(None, "G2", "bad", 0), (None, "G1", "good", 1)]
    (tmp_path / "v.csv").write_text("text,type,start,duration\nhi,Word,1,0.5\n")
    assert tables.read_events(spark, str(tmp_path / "v.csv")).first().asDict() == {"row_id": 0, "type": "Word", "start": 1.0, "duration": 0.5, "text": "hi", "sentence_id": None, "filepath": None, "language": None}
    (folder / "c.tsv").write_text("word\tstart\tend\tspeaker\tpos\tsentence_id\nlast\t9\t9.5\tu\tv\t3\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE|header"):
        tables.read_transcript(spark, str(folder)).collect()


def test_channels(spark):
    rows = [("DC1", "good", 0), ("Pulse Rate", "good", 1), ("EKG1", "good", 2), ("G1", "bad", 3), ("G2", None, 4)]
    table = channels.classify_channels(spark.createDataFrame(rows, "name string, status string, ord int"))
    assert {r.name: (r.kind, r.bad) for r in table.collect()} == {"DC1": ("misc", False), "EKG1": ("ecg", False), "G1": ("seeg", True), "G2": ("seeg", False)}
    assert [r.name for r in channels.pick_channels(table).collect()] == ["G2"]
    targets = spark.createDataFrame([(i, i != 1) for i in range(6)], "target int, keep boolean")
    assert {r.target: r.chunk for r in channels.assign_chunk(targets, 2).collect()} == {0: 0, 2: 0, 3: 1, 4: 1, 5: 2}
    assert {r.chunk for r in channels.assign_chunk(targets).collect()} == {0}


def test_grid(spark):
    grid = time_grid(spark.createDataFrame([(0, 1.04), (1, 0.0)], "recording int, duration double"), 5.0).collect()
    assert [r.t_idx for r in grid] == [0, 1, 2, 3, 4, 5]


def test_signal_and_results(spark, tmp_path):
    rows = [("a", k, t, i, float(i)) for k in (2, 10) for t in range(4) for i in range(3)]
    tables.write_signal(spark.createDataFrame(rows, "recording string, time_id int, target int, t_idx int, value double"), str(tmp_path / "s"))
    keep = spark.createDataFrame([(t, t != 1) for t in range(4)], "target int, keep boolean")
    assert {r.target for r in tables.read_signal(spark, str(tmp_path / "s"), [2], keep, 2, 1).collect()} == {2, 3}
    assert tables.read_signal(spark, str(tmp_path / "s")).count() == 24
    names = spark.createDataFrame([("y10",), ("y2",), ("yx",), ("z3",)], "name string")
    assert [r.time_id for r in tables.latency_ids(names, "y").collect()] == [2, 10]
    out = spark.createDataFrame([("m", 0, 0, "r2", 0.5), ("m", 1, 0, "r2", 0.25)], "model string, fold int, chunk int, kind string, value double")
    for value in (1, 2):
        tables.write_results(out.withColumn("value", out["value"] * value), str(tmp_path / "r"))
    tables.write_results(out.where("fold = 1"), str(tmp_path / "r"))
    assert sorted(r.value for r in tables.gather_results(spark, str(tmp_path / "r"), "m", "r2").collect()) == [0.25, 1.0]
