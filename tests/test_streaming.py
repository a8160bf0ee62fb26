import os

import pytest
from pyspark.sql import functions as F

from loomtext import queries
from loomtext.sources import readers as rd
from loomtext.streaming.transcribe import transcribe_new


@pytest.fixture
def tree(tmp_path):
    for label in ("AD", "HC", "other"):
        (tmp_path / "audio" / label).mkdir(parents=True)
    for name in ("AD/a.wav", "AD/b.mp3", "HC/c.flac", "HC/d.txt", "other/e.wav"):
        (tmp_path / "audio" / name).write_bytes(b"x")
    return tmp_path


def recogniser(log, ends_at=None):
    """Notes each file that it is asked for; at one of them the whole worker ends."""

    def load():
        def recognise(path):
            name = path.rsplit("/", 1)[-1]
            with open(log, "a") as out:
                out.write(name + "\n")
            if name == ends_at:
                os._exit(9)
            return [f"said {name}"], 1.5

        return recognise

    return load


def asked(log):
    return log.read_text().split()


def test_a_broken_run_goes_on_and_no_file_is_there_twice(spark, tree):
    root, target, log = str(tree / "audio"), str(tree / "table"), tree / "log"
    with pytest.raises(Exception, match="(?i)worker|crashed|exited|failed"):
        transcribe_new(spark, root, target, recogniser(log, "b.mp3"), batch=1)
    done = [n for n in asked(log) if n != "b.mp3"]
    table = transcribe_new(spark, root, target, recogniser(log), batch=1)
    assert sorted(r.id for r in table.collect()) == ["AD_a", "AD_b", "HC_c"]
    assert all(asked(log).count(n) == 1 for n in ("a.wav", "c.flac")) and set(done) <= {"a.wav", "c.flac"}
    (tree / "audio" / "MCI").mkdir()
    (tree / "audio" / "MCI" / "f.ogg").write_bytes(b"x")
    again = transcribe_new(spark, root, target, recogniser(log))
    assert sorted((r.id, r.label, r.transcript, r.duration) for r in again.collect())[-1] == ("MCI_f", "MCI", "said f.ogg", "1.5")
    assert again.count() == 4 and asked(log).count("f.ogg") == 1 and asked(log).count("a.wav") == 1
    assert rd.csv_table(spark, target).filter(F.col("id") == "AD_b").count() == 1


def test_caps_labels_and_trees_without_audio(spark, tree):
    root, log = str(tree / "audio"), tree / "log"
    capped = transcribe_new(spark, root, str(tree / "capped"), recogniser(log), cap=1)
    assert sorted(r.id for r in capped.collect()) == ["AD_a", "HC_c"]
    assert [r.id for r in transcribe_new(spark, root, str(tree / "one"), recogniser(log), labels=["hc"]).collect()] == ["HC_c"]
    with pytest.raises(ValueError, match="no audio"):
        transcribe_new(spark, root, str(tree / "none"), recogniser(log), labels=["MCI"])


def test_a_stream_of_one_row_group_is_cleaned_by_many_tasks(spark):
    found = queries.stream_clean(spark, "/root/testdata/sf0.001")
    sizes = [r["n"] for r in found.groupBy(F.col("_metadata.file_path").alias("part")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 2 * spark.sparkContext.defaultParallelism and max(sizes) <= 2 * min(sizes)
