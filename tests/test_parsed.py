"""Parsed sentences beyond the golden queries: readers, edge cases, filters, detector rules, verification, vectors, corpora."""

import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import cues, lexicons, parsed as P, polarity as Y
from tessera.operators import antonym_vectors, detector, filters, generators, pairs, polarity_fit, splice, variants, verification
from tessera.plans.parsed_fixtures import ANTONYMS, SENTENCES
from tessera.sources import corpora, parses

TOKENS = [("The", "the", "DET", "DT", "det", 1, {}), ("task", "task", "NOUN", "NN", "nsubj", 2, {"Number": "Sing"}), ("is", "be", "AUX", "VBZ", "ROOT", 2, {"Tense": "Pres"}), ("simple", "simple", "ADJ", "JJ", "acomp", 2, {}), (".", ".", "PUNCT", ".", "punct", 2, {})]


def test_parsers_are_asked_in_batches(spark):
    asked = parses.parse_sentences(spark.createDataFrame([("a", " The task is simple. "), ("b", "  "), ("c", None)], "sent_id string, text string"), lambda texts: [TOKENS for _ in texts])
    rows = asked.collect()
    assert [(r.sent_id, r.text) for r in rows] == [("a", "The task is simple.")] and [t.idx for t in rows[0].tok] == [0, 4, 9, 12, 18]
    assert generators.generate(asked).where("generator = 'syn_copula_v1'").first().variant == "The task is not simple."


def test_conllu_equals_the_notation(spark, tmp_path):
    lines = ["# sent_id = s1", "# text = He can't go."]
    for k, row in enumerate([("He", "he", "PRON", "PRP", "_", 4, "nsubj", "_"), ("ca", "can", "AUX", "MD", "_", 4, "aux", "SpaceAfter=No"), ("n't", "not", "PART", "RB", "_", 4, "neg", "_"), ("go", "go", "VERB", "VB", "VerbForm=Inf|Tense=Pres", 0, "root", "SpaceAfter=No"), (".", ".", "PUNCT", ".", "_", 4, "punct", "_")], 1):
        form, lemma, pos, tag, feats, head, dep, misc = row
        lines.append("\t".join([str(k), form, lemma, pos, tag, feats, str(head), dep, "_", misc]))
    bare = [x for x in lines if not x.startswith("#")]
    (tmp_path / "x.conllu").write_text("\n".join(lines) + "\n\n" + "\n".join(bare) + "\n\n\n", encoding="utf-8")
    rows = parses.read_conllu(spark, str(tmp_path / "x.conllu")).collect()
    assert [r.text for r in rows] == ["He can't go.", "He can't go."] and [r.sent_id for r in rows] == ["s1", ""]
    assert [(t.idx, t.head, t.dep) for t in rows[0].tok] == [(0, 3, "nsubj"), (3, 3, "aux"), (5, 3, "neg"), (9, 3, "ROOT"), (11, 3, "punct")] and rows[0].tok[3].tense == "Pres"


def test_trees_with_circles_and_without_tokens(spark):
    held = parses.noted_sentences(spark, ["a_NN_dep_2 b_NN_dep_1", "go_VB_ROOT_1"]).unionByName(spark.createDataFrame([("x", "", []), ("y", None, None)], parses.SHAPE))
    depth = {r.sent_id: r.d for r in held.select("sent_id", P.tree_depth(F.col("tok")).alias("d")).collect()}
    assert depth["0"] == -1 and depth["1"] == 0 and depth["x"] == 0
    assert {r.sent_id for r in generators.analysed(held).select("sent_id").collect()} == {"0", "1"}
    assert generators.generate(held.limit(0)).count() == 0


def test_edits_that_overlap_raise(spark):
    one, two = (F.struct(F.lit(a).alias("at"), F.lit(b).alias("until"), F.array(splice.piece("x")).alias("pieces")) for a, b in ((0, 3), (2, 4)))
    with pytest.raises(PySparkException, match="edits overlap"):
        spark.range(1).select(splice.spliced(F.lit("abcdef"), F.array(one, two))).collect()
    row = spark.range(1).select(splice.spliced(F.lit("It  is , so."), F.array(F.struct(F.lit(4).alias("at"), F.lit(4).alias("until"), F.array(splice.piece("by no means ", True)).alias("pieces")))).alias("x")).first().x
    assert row.variant == "It by no means is, so." and row.cue_tokens == ["by", "no", "means"] and [tuple(s) for s in row.cue_char_spans] == [(3, 5), (6, 8), (9, 14)]


def test_variants_are_parsed_again(spark):
    base = parses.noted_sentences(spark, [SENTENCES[0]])
    made = generators.generate(base).where("generator = 'syn_do_support_v1'")
    good = "The_DT_det_2 function_NN_nsubj_5 does=do_VBZ_aux_5 not_RB_neg_5 sort_VB_ROOT_5 the_DT_det_7 array_NN_dobj_5 ~._._punct_5"
    again = lambda s: parses.noted_sentences(spark, [s]).select(F.lit("0").alias("base_id"), F.lit(made.first().variant).alias("variant"), "tok")
    bases = base.select(F.col("sent_id").alias("base_id"), "tok")
    assert filters.parse_checked(made, again(good), bases).first().drop_reason is None
    two_roots = good.replace("aux_5", "ROOT_3")
    assert filters.parse_checked(made, again(two_roots), bases).first().drop_reason == "invalid_parse"
    with pytest.raises(PySparkException, match="more cues"):
        filters.parse_checked(made, again(good.replace("array_NN", "nothing_NN")), bases).collect()
    assert filters.valid(made).count() == 1
    with pytest.raises(PySparkException, match="bad value in voice"):
        filters.valid(made.withColumn("voice", F.lit("loud"))).collect()


def test_surface_affirmations_restore_the_verb():
    said = lambda s: [v[4] for v in variants.variants_of(s) if v[3] == "affirm"]
    assert said("The scheduler does not run the process.") == ["The scheduler runs the process."]
    assert said("The kernel did not run the job.") == ["The kernel ran the job."]
    assert [v[4] for v in variants.variants_of("The students have finished.")] [:1] == ["The students have not finished."]


def test_gate_is_fitted_on_dev_alone(spark):
    rows = spark.createDataFrame([(0.5, 1, 0.9, "test")], "cos double, label int, nli_c double, split string")
    with pytest.raises(PySparkException, match="dev alone"):
        detector.gate_fit(rows, "cos", 0.5).collect()


def test_a_negator_and_an_antonym_cancel(spark):
    good = "It_PRP_nsubj_2 is=be_VBZ_ROOT_2 a_DT_det_5 good_JJ_amod_5 idea_NN_attr_2 ~._._punct_2"
    evil = "It_PRP_nsubj_2 is=be_VBZ_ROOT_2 not_RB_neg_2 an_DT_det_6 evil_JJ_amod_6 idea_NN_attr_2 ~._._punct_2"
    a, b = parses.noted_sentences(spark, [good]).select(F.col("tok").alias("a")), parses.noted_sentences(spark, [evil]).select(F.col("tok").alias("b"))
    rows = a.crossJoin(b).withColumn("found", pairs.diff(F.col("a"), F.col("b")))
    relation = [("good", "ADJ", "evil")]
    assert rows.select(pairs.not_antonym_cancels(relation, F.col("a"), F.col("b"), F.col("found"))).first()[0]
    assert not rows.select(pairs.not_antonym_cancels([], F.col("a"), F.col("b"), F.col("found"))).first()[0]
    assert not rows.select(pairs.antonym_aligned(relation, F.col("found"))).first()[0]


def test_weights_are_fitted_to_the_area(spark):
    cue = "array<struct<text:string,family:string,clause:int,main_clause:boolean,hedged:boolean,intensified:boolean>>"
    make = lambda family: [("x", family, 0, True, False, False)]
    rows = [(make("A_syntactic"), [], 0.9, 1), (make("A_syntactic"), [], 0.8, 1), (make("D_affixal"), [], 0.9, 0), (make("D_affixal"), [], 1.0, 0), ([], [], 0.9, 0)]
    table = spark.createDataFrame(rows, f"b_cues {cue}, a_cues {cue}, cos double, label int")
    families, _, trace = polarity_fit.fit_weights(table, 1, {"A_syntactic": 0.5, "D_affixal": 1.0}, {"neutral": 0.9})
    assert trace == [0.3333, 1.0] and families["A_syntactic"] * 0.8 > families["D_affixal"]


def test_conditionals_of_connectives(spark):
    text = lambda m: f"{m} it_PRP_nsubj_4 rains=rain_VBZ_advcl_7 we_PRP_nsubj_7 will_MD_aux_7 stay_VB_ROOT_7 ~._._punct_7"
    rows = parses.noted_sentences(spark, [text("Even_RB_advmod_4 if_IN_mark_4"), text("As_IN_advmod_4 if_IN_mark_4"), text("Well_RB_advmod_4 unless_IN_mark_4")])
    found = {r.sent_id: [c.marker for c in r.k] for r in rows.select("sent_id", Y.conditionals(F.col("tok")).alias("k")).collect()}
    assert found == {"0": ["even if"], "1": [], "2": ["unless"]}


def test_answers_of_judges_are_read_tolerantly():
    whole = [{"id": 0, "grammatical": True}, {"id": 1, "grammatical": False}]
    for raw in (json.dumps(whole), "```json\n" + json.dumps(whole) + "\n```", json.dumps({"judgements": whole}), "Sure! Here: " + json.dumps(whole) + " Done."):
        assert verification.read_verdicts(raw) == whole
    assert verification.read_verdicts(json.dumps(whole)[:-10]) == whole[:1] and verification.read_verdicts("none") == [] and verification.read_verdicts("") == []
    calls = []

    def judge(asked):
        items = json.loads(asked[asked.index("\n") + 1 :])
        calls.append(len(items))
        if len(items) > 1:
            raise OSError("down")
        return json.dumps([{"id": 0, "category": items[0]["variant"] == "a"}])

    assert [v["category"] for v in verification.judged([{"variant": "a"}, {"variant": "b"}], judge)] == [True, False] and calls == [2, 2, 1, 1]


def test_maps_between_vectors(spark):
    rng = np.random.default_rng(2)
    normal = rng.standard_normal(6)
    normal /= np.linalg.norm(normal)
    x = rng.standard_normal((80, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = antonym_vectors.mirrored(x, normal, 0.0)
    words = [(f"w{i}", [float(a) for a in v]) for i, v in enumerate(x)] + [(f"o{i}", [float(a) for a in v]) for i, v in enumerate(y)]
    vectors = spark.createDataFrame(words, "word string, vec array<double>")
    given = spark.createDataFrame([(f"w{i}", f"o{i}", "ADJ") for i in range(80)] + [("w1", "missing", "ADJ"), ("w2", "o2", "VERB")], "word string, antonym string, pos string")
    held = antonym_vectors.training_pairs(given, vectors).cache()
    planes = antonym_vectors.reflections(held)
    assert set(planes) == {"ADJ"} and abs(abs(planes["ADJ"][0] @ normal) - 1) < 1e-3 and abs(planes["ADJ"][1]) < 1e-3
    w = antonym_vectors.linear_map(held.where("pos = 'ADJ'"), 0.5)
    assert np.allclose(w, np.linalg.solve(x.T @ x + 0.5 * np.eye(6), x.T @ y), atol=1e-8)
    assert antonym_vectors.ridge_alpha(held.where("pos = 'ADJ'"), (0.01, 1000.0)) == 0.01
    ranks = antonym_vectors.ranked(antonym_vectors.predicted(spark.createDataFrame([("w3", "ADJ"), ("w3", "NOUN")], "word string, pos string"), vectors, planes), vectors, 3).collect()
    assert [r.candidate for r in ranks if r["rank"] == 1] == ["o3"] and len(ranks) == 3
    moved = antonym_vectors.counter_fitted({"a": np.array([1.0, 0.2]), "b": np.array([1.0, 0.0]), "c": np.array([0.0, 1.0])}, [("a", "b")], [])
    cos = lambda u, v: u @ v / np.linalg.norm(u) / np.linalg.norm(v)
    assert cos(moved["a"], moved["b"]) < 0.9 and (moved["c"] == [0.0, 1.0]).all()


XML = """<d><SENTENCE>It <xcope ID="2"><ref SRC="1"/>was <cue ID="1" type="negation">not</cue> everyone here</xcope> .</SENTENCE>
<sentence id="S7">We <xcope id="X1"><cue type="speculation" ref="X1">suggest</cue> a role</xcope></sentence><sentence> </sentence></d>"""


def test_corpora_become_instances(spark, tmp_path):
    folder = tmp_path / "BOOKS"
    folder.mkdir()
    (folder / "one.xml").write_text(XML)
    (folder / "two.xml").write_text("<d><broken>")
    rows = {r.cue_text: r for r in corpora.read_annotated_xml(spark, str(folder), "SFU").collect()}
    assert set(rows) == {"not", "suggest"} and rows["not"].cue_family == "L_scope_position" and rows["suggest"].cue_family == "H_hedged"
    assert [tuple(s) for s in rows["not"].cue_spans] == [(2, 3)] and [tuple(s) for s in rows["not"].scope_spans] == [(1, 2), (3, 5)]
    assert [tuple(s) for s in rows["suggest"].scope_spans] == [(2, 4)] and rows["suggest"].sentence_id == "sfu:BOOKS:one:S7" and rows["not"].extra == {"category": "BOOKS", "document": "one"}
    (tmp_path / "c.tsv").write_text("premise\thypothesis\tlabel\np one\th one\t1\np two\t \t0\np three\th  three\t0\n")
    found = corpora.read_cannot(spark, str(tmp_path / "c.tsv")).collect()
    assert [(r.sentence_id, r.tokens, r.extra["label"], r.provenance, r.cue_family) for r in found] == [("cannot:0", ["h", "one"], "1", "pair-level-only", "unmapped"), ("cannot:2", ["h", "three"], "0", "pair-level-only", "unmapped")]
    (tmp_path / "n.txt").write_bytes("Text\tHypothesis\tgold_label\nx\tcaf\xe9 not\tno\n".encode("latin-1"))
    assert corpora.read_negnli(spark, {"RTE": str(tmp_path / "n.txt")}).first().sentence == "café not"
    (tmp_path / "nan.csv").write_text('premise,hypothesis,label,Construction,Construction Subtype\na,"b\nc",e,verbal,x\n')
    assert corpora.read_nan_nli(spark, str(tmp_path / "nan.csv")).first().extra["construction"] == "verbal"
    (tmp_path / "p.tsv").write_text("# note\nbase_line\tmethod\tkeep\ttext\tnote\n1\tm\t1\tkept\tn\n2\tm\t0\tgone\tn\n")
    assert [(r.base_line, r.text) for r in corpora.read_paraphrases(spark, str(tmp_path / "p.tsv")).collect()] == [(1, "kept")]
    (tmp_path / "s.jsonl").write_text('{"sentence1": "a", "sentence2": "b", "score": 2.5}\n{"sentence1": "a"}\n')
    assert [tuple(r) for r in corpora.read_scored_pairs(spark, str(tmp_path / "s.jsonl"), "json").collect()] == [("a", "b", None, 2.5)]
    assert corpora.catalogue(spark).count() == 6


def test_definitions_and_offsets(spark):
    row = spark.range(1).select(
        cues.char_offsets(F.array(F.lit("a"), F.lit("bcd"), F.lit("e"))).alias("at"), cues.lead_sentence(F.lit("A lock (in computing) is a  guard[1] . It waits.")).alias("lead"), cues.partial(F.lit("No copula here")).alias("none")
    ).first()
    assert row.at == [0, 2, 6] and row.lead == "A lock is a guard." and row.none is None


def test_lexicons_hold_together():
    assert len(lexicons.IRREGULAR_VERBS) == 68 and dict((a, b) for a, b, _ in lexicons.IRREGULAR_VERBS)["get"] == "got" and [c for a, _, c in lexicons.IRREGULAR_VERBS if a == "get"] == ["gotten"]
    assert set(lexicons.QUANTIFIER_SWAPS.values()) - set(lexicons.NEGATIVE_ADVERBS) <= {*lexicons.QUANTIFIER_FLIPS, "none of the", "no one"}
    assert all(any(h in p.split() for h in lexicons.PRIVATIVE_HEADS) for p, _ in lexicons.WITH_REPLACEMENTS + lexicons.COPULAR_PRIVATIVES)
    assert {f for f, *_ in ANTONYMS} and len({r.name for r in generators.RULES}) == len(generators.RULES) == 35
