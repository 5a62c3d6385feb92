"""Sources, variants, resampling and the resumable stream."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import resampling, variants
from tessera.sources import readers
from tessera.streaming.resume import verify_stream


def test_sentences_are_numbered_without_blank_lines(spark, tmp_path):
    (tmp_path / "s.txt").write_text("one\n\n  two \n \nthree\n")
    assert [tuple(r) for r in readers.read_sentences(spark, str(tmp_path)).orderBy("ord").collect()] == [(0, "one"), (1, "two"), (2, "three")]


def test_conll_instances(spark, tmp_path):
    row = lambda i, w, *more: "\t".join(["c1", "0", str(i), w, w, "X", "p", *more])
    first = "\n".join([row(0, "He", "_", "He", "_"), row(1, "never", "never", "_", "_"), row(2, "came", "_", "came", "came")])
    second = "\n".join(["\t".join(["c1", "1", "0", "Fine", "Fine", "X", "p", "***"])])
    (tmp_path / "c.txt").write_text(first + "\n\n" + second + "\n\n")
    (r,) = readers.read_conll(spark, str(tmp_path)).withColumn("spans", readers.index_spans(F.col("scope_idx"))).collect()
    assert (r.sentence, r.cue_text, r.cue_idx, r.scope_idx) == ("He never came", "never", [1], [0, 2])
    assert [tuple(s) for s in r.spans] == [(0, 1), (2, 3)]


def test_inline_xml_keeps_owners(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<d><sentence>It <xcope id='1'>does <cue ref='1'>not</cue> work</xcope> .</sentence></d>")
    (tmp_path / "b.xml").write_text("<d><sentence>broken")
    found = readers.cue_scopes(readers.read_inline_xml(spark, str(tmp_path)))
    assert {r.owner: r.idx for r in found.collect()} == {"xcope:1": [1, 2, 3], "cue:1": [2]}


def test_records_skip_malformed_lines_and_keep_nulls(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"base_id":"a","variant":"x","verified":null}\n{broken\n{"base_id":"b","variant":"y","verified":false}\n')
    assert sorted((r.base_id, r.verified) for r in readers.read_records(spark, str(tmp_path)).where("base_id IS NOT NULL").collect()) == [("a", None), ("b", False)]


def test_vectors(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 3\ncat 1 2 3\ndog 4 5 6\n")
    assert [(r.word, r.vec) for r in readers.read_vectors(spark, str(tmp_path)).orderBy("word").collect()] == [("cat", [1, 2, 3]), ("dog", [4, 5, 6])]


@pytest.mark.parametrize(
    "base,variant",
    [
        ("The door is open.", "The door is not open."), ("We can go now.", "We cannot go now."), ("She went home.", "She did not go home."), ("He knows it.", "He does not know it."),
        ("All the birds sing.", "None of the birds sing."), ("Everyone left.", "No one left."), ("It is cold.", "It is hardly cold."), ("It is not cold.", "It is cold."),
        ("He won't go.", "He will go."), ("Nobody came.", "Somebody came."), ("They rarely sing.", "They often sing."),
    ],
)
def test_variants(base, variant):
    assert variant in [v[4] for v in variants.variants_of(base)]


def test_variant_spans_and_filters(spark):
    rows = spark.createDataFrame([("s0", "Some of it is good."), ("s1", "It is not not so."), ("s2", None), ("s3", "")], "base_id string, sentence string")
    found = variants.run(rows).collect()
    assert found and all(r.variant[a:b] == c for r in found for c, (a, b) in zip(r.cue_tokens, r.cue_char_spans))
    assert len({(r.base_id, r.variant) for r in found}) == len(found)
    reasons = {r.drop_reason for r in variants.tagged(variants.generate(rows)).collect()}
    assert "duplicate" in reasons


def test_resampling(spark):
    rows = spark.range(1000).select((F.col("id") % 4 > 0).alias("a"), (F.col("id") % 2 > 0).alias("b"), (F.col("id") % 50).alias("g"))
    mean, low, high = resampling.accuracy_interval(rows, "a")
    assert mean == 0.75 and 0.71 < low < 0.75 < high < 0.79
    assert resampling.paired_permutation(rows, "a", "b") < 0.001 and resampling.paired_permutation(rows, "a", "a") == 1
    mean, low, high = resampling.cluster_interval(rows, "g", "a")
    assert low < mean < high


def test_stream_judges_each_record_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    line = '{"base_sentence":"a","variant":"%s","family":"f"}\n'
    judge = lambda todo: todo.withColumn("verified", F.length("variant") > 1)
    (tmp_path / "in/1.jsonl").write_text(line % "xx" + line % "y" + line % "xx")
    verify_stream(spark, source, target, checkpoint, judge).awaitTermination(60)
    (tmp_path / "in/2.jsonl").write_text(line % "y" + line % "zz")
    verify_stream(spark, source, target, checkpoint, judge).awaitTermination(60)
    assert sorted((r.variant, r.verified) for r in spark.read.parquet(target).collect()) == [("xx", True), ("y", False), ("zz", True)]
