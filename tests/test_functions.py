"""Column functions against plain Python."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import morphology, text, vectors
from tessera.operators import verification
from tessera.operators.components import shared_components


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("lemma,forms", [("walk", ("walks", "walked", "walked", "walking")), ("try", ("tries", "tried", "tried", "trying")), ("stop", ("stops", "stopped", "stopped", "stopping")), ("go", ("goes", "went", "gone", "going")), ("bake", ("bakes", "baked", "baked", "baking")), ("lie", ("lies", "lied", "lied", "lying"))])
def test_verb_forms(spark, lemma, forms):
    c = F.lit(lemma)
    made = (morphology.third_person(c), morphology.past(c), morphology.past_participle(c), morphology.present_participle(c))
    assert tuple(value(spark, m) for m in made) == forms


def test_negative_derivations(spark):
    assert value(spark, morphology.negative_derivations(F.lit("possible"))) == ["unpossible", "inpossible", "impossible", "nonpossible", "dispossible"]
    assert value(spark, morphology.negative_derivations(F.lit("useful")))[-1] == "useless"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_word_edit_distance(spark):
    words = [[], ["a"], ["a", "b"], ["b", "a", "c"], ["a", "b", "c", "d"]]
    rows = spark.createDataFrame([(a, b) for a, b in itertools.product(words, words)], "a array<string>, b array<string>")
    for r in rows.select("a", "b", text.word_edit_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert r.d == distance(r.a, r.b), (r.a, r.b)


def test_edit_distance_in_blocks():
    draw = random.Random(5)
    for _ in range(300):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(20))] for _ in range(2))
        assert all(text.edit_distance(a, b, block) == distance(a, b) for block in (1, 3, 4096)), (a, b)


def test_word_edit_distance_of_long_texts(spark):
    draw = random.Random(3)
    a, b = ([f"w{draw.randrange(400)}" for _ in range(2000)] for _ in range(2))
    rows = spark.createDataFrame([(a, b), (a, None)], "a array<string>, b array<string>")
    began = time.perf_counter()
    found = [r.d for r in rows.select(text.word_edit_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    took = time.perf_counter() - began
    assert found == [distance(a, b), None] and took < 15


@pytest.mark.parametrize("t,n", [("He did not go.", 1), ("It isn't useless.", 2), ("Nothing.", 1), ("a fine day", 0), ("", 0)])
def test_cue_count(spark, t, n):
    assert value(spark, text.cue_count(F.lit(t))) == n


def test_soft_xor(spark):
    assert value(spark, text.soft_xor(F.array(F.lit(1.0), F.lit(1.0)))) == 0
    assert abs(value(spark, text.soft_xor(F.array(F.lit(0.9), F.lit(0.8)))) - 0.26) < 1e-12


def test_blacklist_counts_against_the_base(spark):
    assert value(spark, text.blacklist_hit(F.lit("it is not not so"), F.lit("it is so"))) == "repeated_not"
    assert value(spark, text.blacklist_hit(F.lit("no no way"), F.lit("no no way"))) is None


def test_spacing_and_case(spark):
    assert value(spark, text.spacing(F.lit(" a  b , c ."))) == "a b, c."
    assert value(spark, text.lower_initial(F.lit("The"))) == "the"
    assert value(spark, text.lower_initial(F.lit("NATO"))) == "NATO"
    assert value(spark, text.like_case(F.lit("never"), F.lit("Always"))) == "Never"


def test_swap_middle_keeps_words(spark):
    for pick in range(4):
        out = value(spark, text.swap_middle(F.lit("a b c d e"), F.lit(pick)))
        assert sorted(out.split()) == list("abcde") and out != "a b c d e"
    assert value(spark, text.swap_middle(F.lit("a b"), F.lit(0))) == "a b"


def test_residual_is_orthogonal(spark):
    axis = vectors.unit(F.array(*map(F.lit, (1.0, 2.0, 2.0))))
    assert abs(value(spark, vectors.dot(vectors.residual(F.array(*map(F.lit, (3.0, -1.0, 4.0))), axis), axis))) < 1e-12


@pytest.mark.parametrize("raw", ['```json\n[{"a":1}]\n```', '{"results":[{"a":1}]}', '{"a":1}', '[{"a":1}]'])
def test_answer_rows(spark, raw):
    assert value(spark, F.get_json_object(verification.answer_rows(F.lit(raw)), "$[0].a")) == "1"


def test_answer_rows_of_prose(spark):
    assert value(spark, verification.answer_rows(F.lit("I think so."))) is None


def test_three_valued(spark):
    null = F.lit(None).cast("boolean")
    assert value(spark, verification.all_three(F.lit(True), null)) is None
    assert value(spark, verification.all_three(F.lit(False), null)) is False


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, f"v{i}") for i in range(40)] + [(i + 1, f"v{i}") for i in range(39)] + [(100, "x"), (None, "v1"), (101, None)], "n int, v string")
    found = {r.node: r.component for r in shared_components(links, "n", "v").collect()}
    assert found == {i: 0 for i in range(40)} | {100: 100}


def test_running_sums_over_ranges(spark):
    from tessera.operators import metrics

    rows = spark.range(1000).select((F.col("id") * 7 % 1000).cast("double").alias("v"), (F.col("id") % 3).alias("w"))
    for descending in (False, True):
        held = sorted(((r.v, r.w, r.s) for r in metrics.running(rows, "v", {"s": "w"}, descending).collect()), reverse=descending)
        total = 0
        for v, w, s in held:
            total += w
            assert s == total
    ranked = metrics.average_ranks(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double"), "v", "r")
    assert sorted(r.r for r in ranked.collect()) == [1, 2.5, 2.5, 4]
