"""Queries of cue mapping, definitions, templates, reference sets, verification and antonym vectors, over literal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import cues as C, lexicons
from tessera.operators import antonym_vectors as A, generators, summaries, verification as T
from tessera.plans.parsed_golden import TEMPLATES, VARIANTS
from tessera.plans.parsed_queries import CUES, RELATION, TOK, trees, values
from tessera.plans.registry import query

# Read from the mapping's definition: (cue, token, annotation, family).
_CUES = [
    ("not", "not", "negation", "A_syntactic"), ("n’t", "n’t", "negation", "A_syntactic"), ("un", "unhappy", "negation", "D_affixal"), ("less", "useless", "negation", "D_affixal"),
    ("by no means", "by", "negation", "I_intensified"), ("far from", "far", "negation", "J_contrastive"), ("No one", "No", "negation", "B_quantifier"), ("never", "never", "negation", "C_neg_adverb"),
    ("neither nor", "neither", "negation", "B_quantifier"), ("without", "without", "negation", "G_prepositional"), ("absence of", "absence", "negation", "G_prepositional"),
    ("failed", "failed", "negation", "F_implicit"), ("failure", "failure", "negation", "F_implicit"), ("impossible", "impossible", "negation", "D_affixal"), ("empty", "empty", "negation", "F_implicit"),
    ("perhaps", "perhaps", "speculation", "H_hedged"), ("exclude", "exclude", "negation", "unmapped"), ("", "x", "negation", "unmapped"), ("in", "in", "negation", "unmapped"),
]


@query("cue_mapping", f"WITH {values('t', 'cue, word, annotation, family', _CUES)} SELECT * FROM t")
def cue_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family of every annotated cue."""
    given = spark.createDataFrame([r[:3] for r in _CUES], "cue string, word string, annotation string")
    return given.select("cue", "word", "annotation", C.family(F.col("cue"), F.col("word"), F.col("annotation")).alias("family"))


@query("scope_position_cues", "SELECT * FROM (VALUES (0, 'L_scope_position'), (1, 'A_syntactic'), (2, 'B_quantifier')) t(id, family)")
def scope_position_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues before a quantifier are of scope, if they are syntactic."""
    given = spark.createDataFrame([(0, "A_syntactic", "Not everyone passed".split(), [0]), (1, "A_syntactic", "He did not".split(), [2]), (2, "B_quantifier", "No all".split(), [0])], "id int, label string, tokens array<string>, at array<int>")
    return given.select("id", C.scope_position(F.col("label"), F.col("tokens"), F.col("at")).alias("family"))


@query(
    "token_alignment",
    f"""WITH {TOK}, words AS (SELECT sent_id, idx AS at, i FROM tok) SELECT sent_id, CAST(row_number() OVER (PARTITION BY sent_id ORDER BY i) - 1 AS BIGINT) AS word, CAST(i AS BIGINT) AS token FROM words
        WHERE NOT EXISTS (SELECT 1 FROM tok b WHERE b.sent_id = words.sent_id AND b.idx + length(b.form) = words.at)""",
)
def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words between blanks with the parser's token that holds their first character."""
    found = trees(spark).select("sent_id", F.posexplode(C.aligned(F.split("text", " "), F.col("tok"))).alias("word", "token"))
    return found.select("sent_id", F.col("word").cast("long"), F.col("token").cast("long"))


# Read from the templates' definition: (id, definition, partial, first to fourth paraphrase).
_DEFINITIONS = [
    ("A semaphore is a variable that controls access.", "A semaphore is a variable.", "a semaphore"), ("TCP is a protocol used for reliable delivery.", "TCP is a protocol.", "TCP"), ("Deadlocks are states in which nothing moves.", None, "deadlocks"),
]
_RESTS = ["a variable that controls access", "a protocol used for reliable delivery", "states in which nothing moves"]


@query(
    "definition_forms",
    f"""WITH {values('t', 'definition, partial, subj, rest', [(d, p or '', s, r) for (d, p, s), r in zip(_DEFINITIONS, _RESTS)])} SELECT definition, partial, CASE WHEN subj = 'deadlocks' THEN 'Put simply, deadlocks are ' || rest || '.' ELSE 'The term ' || subj || ' refers to ' || rest || '.' END AS second,
        CASE WHEN subj = 'deadlocks' THEN 'Put simply, deadlocks are ' || rest || '.' ELSE upper(left(rest, 1)) || substr(rest, 2) || ': that is what ' || subj || ' means.' END AS fourth FROM t""",
)
def definition_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions cut short and in other words; empty where the rest would be too short."""
    given = spark.createDataFrame([(d,) for d, *_ in _DEFINITIONS], "definition string")
    c = F.col("definition")
    return given.select(c, F.coalesce(C.partial(c), F.lit("")).alias("partial"), C.paraphrase(c, F.lit(1)).alias("second"), C.paraphrase(c, F.lit(3)).alias("fourth"))


_CONTENTS = [("everyday", "it rains", "it does not rain", "the match stops", "the match does not stop"), ("OS", "the queue is empty", "the queue is not empty", "the unit waits", "the unit does not wait")]


@query(
    "conditional_templates",
    f"""WITH {values('c', 'topic, p, np, q, nq', _CONTENTS)}, u AS (SELECT *, upper(left(p, 1)) || substr(p, 2) AS up, upper(left(np, 1)) || substr(np, 2) AS unp, upper(left(q, 1)) || substr(q, 2) AS uq, upper(left(nq, 1)) || substr(nq, 2) AS unq FROM c),
        pre AS (SELECT topic, 'If ' || p || ', ' || q || '.' AS a, uq || ' if ' || p || '.' AS after, * EXCLUDE (topic) FROM u)
        SELECT topic, a, 'If ' || np || ', ' || q || '.' AS b, 0 AS label, 'cond_antecedent_flip' AS kind, 'antecedent flip|preposed' AS template FROM pre UNION ALL
        SELECT topic, a, 'If ' || np || ', ' || nq || '.', 0, 'cond_inverse', 'inverse|preposed' FROM pre UNION ALL SELECT topic, a, 'If ' || p || ', ' || nq || '.', 1, 'cond_consequent_flip', 'consequent flip|preposed' FROM pre UNION ALL
        SELECT topic, a, up || ', but ' || nq || '.', 1, 'cond_logical_negation', 'logical negation|fact' FROM pre UNION ALL SELECT topic, a, 'If ' || nq || ', ' || np || '.', 0, 'cond_contrapositive', 'contrapositive|preposed' FROM pre UNION ALL
        SELECT topic, a, 'Unless ' || p || ', ' || q || '.', 0, 'cond_unless', 'unless|preposed' FROM pre UNION ALL SELECT topic, a, 'Even if ' || np || ', ' || q || '.', 0, 'cond_even_if', 'even if|preposed' FROM pre UNION ALL
        SELECT topic, a, uq || ' only if ' || p || '.', 0, 'cond_only_if', 'only if|postposed' FROM pre UNION ALL SELECT topic, after, uq || ' if ' || np || '.', 0, 'cond_antecedent_flip', 'antecedent flip|postposed' FROM pre UNION ALL
        SELECT topic, after, unq || ' if ' || np || '.', 0, 'cond_inverse', 'inverse|postposed' FROM pre UNION ALL SELECT topic, after, unq || ' if ' || p || '.', 1, 'cond_consequent_flip', 'consequent flip|postposed' FROM pre UNION ALL
        SELECT topic, after, unp || ' if ' || nq || '.', 0, 'cond_contrapositive', 'contrapositive|postposed' FROM pre""",
)
def conditional_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of conditionals: every content in all twelve templates."""
    return summaries.conditional_pairs(spark.createDataFrame(_CONTENTS, "topic string, p string, np string, q string, nq string"))


_PLAIN = [line.split("\t") for line in VARIANTS.splitlines()]
_MADE = values("made", "base_id, generator, net, variant", [(r[0], r[1], int(r[3]), r[5]) for r in _PLAIN if r[1] not in TEMPLATES])
_HELD = values("cue", "sent_id", [(str(c[0]),) for c in CUES])


@query(
    "variant_reference_sets",
    f"""WITH {_MADE}, {_HELD}, n AS (SELECT base_id, (SELECT count(*) FROM cue WHERE sent_id = base_id) AS k FROM (SELECT DISTINCT base_id FROM made))
        SELECT base_id, count(*) AS n_variants, count(*) FILTER (net % 2 <> k % 2) AS n_neg, count(*) FILTER (net % 2 = k % 2) AS n_same, count(*) FILTER (net % 2 <> k % 2) = 0 AS coverage_fail FROM made JOIN n USING (base_id) GROUP BY base_id""",
)
def variant_reference_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every sentence the variants that flip its parity of negations, and those that keep it."""
    made = generators.generate(trees(spark), RELATION).where(~F.col("generator").isin(TEMPLATES))
    sets = summaries.reference_sets(made)
    return sets.select("base_id", "n_variants", F.size("neg").cast("long").alias("n_neg"), F.size("same").cast("long").alias("n_same"), "coverage_fail")


@query("lexicon_sizes", "SELECT * FROM (VALUES ('antonyms', 26), ('blacklist', 14), ('blocklist', 8), ('contrastive', 3), ('copular_privatives', 3), ('do_forms', 3), ('explicit_cues', 20), ('flips', 9), ('groups', 15), ('hedges', 5), ('implicit_swaps', 6), ('intensifiers', 6), ('irregular_verbs', 68), ('lexically_negative', 61), ('modal_readings', 8), ('modals', 11), ('negative_adverbs', 6), ('noun_stems', 13), ('prefixes', 7), ('scope_bearing', 9), ('swaps', 17), ('triggers', 6)) t(lexicon, n)")
def lexicon_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries each lexicon has."""
    held = {
        "antonyms": lexicons.CURATED_ANTONYMS, "blacklist": lexicons.BLACKLIST, "blocklist": lexicons.AFFIXAL_BLOCKLIST, "contrastive": lexicons.CONTRASTIVE_FRAMES, "copular_privatives": lexicons.COPULAR_PRIVATIVES,
        "do_forms": lexicons.DO_FORM_TAGS, "explicit_cues": lexicons.EXPLICIT_CUES, "flips": lexicons.QUANTIFIER_FLIPS, "groups": lexicons.FAMILY_GROUPS, "hedges": lexicons.HEDGES, "implicit_swaps": lexicons.IMPLICIT_SWAPS,
        "intensifiers": lexicons.INTENSIFIERS, "irregular_verbs": lexicons.IRREGULAR_VERBS, "lexically_negative": lexicons.LEXICALLY_NEGATIVE, "modal_readings": lexicons.MODAL_READINGS, "modals": lexicons.MODALITY,
        "negative_adverbs": lexicons.NEGATIVE_ADVERBS, "noun_stems": lexicons.NOUN_STEMS, "prefixes": lexicons.NEGATIVE_PREFIXES, "scope_bearing": lexicons.SCOPE_BEARING, "swaps": lexicons.QUANTIFIER_SWAPS, "triggers": lexicons.IMPLICIT_TRIGGERS,
    }
    return spark.createDataFrame([(k, len(v)) for k, v in held.items()], "lexicon string, n int")


@query(
    "family_groups",
    "SELECT * FROM (VALUES ('A_syntactic', 'explicit'), ('D_affixal', 'implicit'), ('G_prepositional', 'implicit'), ('K1_cancellation', 'cancellation'), ('K2_compound', 'compound'), ('M_modal', 'other'), ('CONTROL_paraphrase', 'control')) t(family, grp)",
)
def family_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of a family."""
    names = ["A_syntactic", "D_affixal", "G_prepositional", "K1_cancellation", "K2_compound", "M_modal", "CONTROL_paraphrase"]
    return spark.createDataFrame([(n,) for n in names], "family string").select("family", summaries.grouped(F.col("family")).alias("grp"))


# verification with a scorer and a judge that follow the text


def _scorer(texts: list[str]) -> list[float]:
    return [0.1 if "bad" in t else 0.9 for t in texts]


def _judge(asked: str) -> str:
    """Answers in an envelope; refuses batches that hold `slow`, and leaves `open` unanswered."""
    import json

    items = json.loads(asked[asked.index("\n") + 1 :])
    if len(items) > 1 and any("slow" in x["variant"] for x in items):
        raise TimeoutError("too slow")
    said = [{"id": x["id"], "grammatical": "yes", "semantic": "wrong" not in x["variant"], "category": True, "suggested_family": "D_affixal" if "wrong" in x["variant"] else "Z", "confidence": 1.5} for x in items if "open" not in x["variant"]]
    return "```json\n" + json.dumps({"verdicts": said}) + "\n```"


_RECORDS = [("b", v, "A_syntactic") for v in ("good one", "bad one", "wrong one", "open one", "slow one", "known one", "other known")]


@query(
    "verification_run",
    """SELECT * FROM (VALUES ('good one', true, 'pass', NULL, 1.0), ('bad one', false, 'cola_reject', NULL, NULL), ('wrong one', false, 'llm_reject:semantic', 'D_affixal', 1.0), ('open one', NULL, 'llm_parse_failure', NULL, NULL),
        ('slow one', true, 'pass', NULL, 1.0), ('known one', false, 'llm_reject:category|cached', 'B_quantifier', 0.5), ('other known', true, 'pass', NULL, 1.0)) t(variant, verified, verify_reason, suggested_family, verify_confidence)""",
)
def verification_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records through score, cache and judge: what the score rejects no judge sees, a verdict of another model doesn't count."""
    records = spark.createDataFrame(_RECORDS, "base_sentence string, variant string, family string")
    key = lambda v: T.verdict_key(F.lit("b"), F.lit(v), F.lit("A_syntactic"))
    held = {"verified": F.lit(False), "verify_grammatical": F.lit(True), "verify_semantic": F.lit(True), "verify_category": F.lit(False), "suggested_family": F.lit("B_quantifier"), "verify_reason": F.lit("llm_reject:category"), "verify_confidence": F.lit(0.5)}
    cache = spark.range(1).select(key("known one").alias("key"), F.lit("m").alias("verify_model"), *[c.alias(n) for n, c in held.items()])
    cache = cache.unionByName(spark.range(1).select(key("other known").alias("key"), F.lit("another").alias("verify_model"), *[c.alias(n) for n, c in held.items()]))
    out = T.verify(records, _scorer, _judge, "m", ["A_syntactic", "B_quantifier", "D_affixal"], 0.5, cache)
    return out.select("variant", "verified", "verify_reason", "suggested_family", "verify_confidence")


@query("kappa_words", "SELECT * FROM (VALUES (-0.1, 'poor'), (0.1, 'slight'), (0.2, 'fair'), (0.5, 'moderate'), (0.6, 'substantial'), (0.9, 'almost perfect')) t(kappa, strength)")
def kappa_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a kappa is called."""
    rows = spark.createDataFrame([(k,) for k in (-0.1, 0.1, 0.2, 0.5, 0.6, 0.9)], "kappa double")
    return rows.select("kappa", T.kappa_strength(F.col("kappa")).alias("strength"))


# antonym vectors: points of the plane, mirrored at the line x = 0

_POINTS = [("hot", 0.8, 0.6), ("cold", -0.8, 0.6), ("warm", 0.78, 0.63), ("wet", 0.1, 1.0), ("dry", -0.1, 1.0), ("x1", 0.0, -1.0)]
_VEC = values("v", "word, x, y", _POINTS)


@query(
    "antonym_ranks",
    f"""WITH {_VEC}, n AS (SELECT word, x / sqrt(x * x + y * y) AS x, y / sqrt(x * x + y * y) AS y FROM v), s AS (SELECT q.word, c.word AS candidate, round(-q.x * c.x + q.y * c.y, 9) AS score FROM n q JOIN n c ON q.word <> c.word)
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY word ORDER BY score DESC, candidate) AS BIGINT) AS rank FROM s) WHERE rank <= 2""",
)
def antonym_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two candidates nearest to each word's mirror image."""
    return _ranks(spark, 2).select("word", "candidate", "score", F.col("rank").cast("long"))


def _ranks(spark: SparkSession, top: int) -> DataFrame:
    import numpy as np

    vectors = spark.createDataFrame([(w, [x, y]) for w, x, y in _POINTS], "word string, vec array<double>")
    mirror = A.predicted(vectors.select("word", F.lit("ADJ").alias("pos")), vectors, {"ADJ": (np.array([1.0, 0.0]), 0.0)})
    return A.ranked(mirror, vectors, top)


@query("antonym_answers", "SELECT * FROM (VALUES ('hot', 'cold', 1.0), ('cold', 'warm', 0.9994), ('warm', 'cold', 0.9994), ('wet', 'dry', 1.0), ('dry', 'wet', 1.0)) t(word, antonym, confidence)")
def antonym_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that no veto forbids and that stand out: cold's best is vetoed, nothing is near the mirror image of x1."""
    vetoed = spark.createDataFrame([("cold", "hot")], "word string, synonym string")
    return A.answers(_ranks(spark, 3), vetoed).select("word", "antonym", "confidence")


@query("antonym_precision", "SELECT CAST(4 AS BIGINT) AS n, 0.75 AS p_1, 1.0 AS p_5, 0.25 AS synonym_1")
def antonym_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of words with an antonym in first place and among five, and with a synonym in first place: cold's is warm or hot."""
    gold = spark.createDataFrame([("hot", "ADJ", "cold"), ("cold", "ADJ", "warm"), ("wet", "ADJ", "dry"), ("dry", "ADJ", "wet")], "word string, pos string, antonym string")
    return A.precision_at(_ranks(spark, 5), gold, spark.createDataFrame([("cold", "hot")], "word string, synonym string"), (1, 5))
