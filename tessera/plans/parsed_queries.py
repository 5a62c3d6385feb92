"""Queries of parsed sentences. The trees come as literals; SQL reads the same tokens as rows and walks them by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import lexicons, parsed as P, polarity as Y
from tessera.operators import affirmations, filters, generators
from tessera.plans.parsed_fixtures import ANTONYMS, SENTENCES
from tessera.plans.parsed_golden import TEMPLATE_SENTENCES, TEMPLATES, VARIANTS
from tessera.plans.registry import query
from tessera.sources.parses import noted, noted_sentences, token_rows

RELATION = ANTONYMS + lexicons.prefixed_antonyms()


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A SQL table of literal rows."""
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)})"


_ROWS = [(str(n), t["i"], t["idx"], t["text"], t["lower"], t["lemma"], t["pos"], t["tag"], t["dep"], t["head"]) for n, s in enumerate(SENTENCES) for t in token_rows(*noted(s))]
TOK = values("tok", "sent_id, i, idx, form, lower, lemma, pos, tag, dep, head", _ROWS)
BOUNDARY = "('conj', 'advcl', 'ccomp', 'csubj', 'csubjpass', 'parataxis', 'relcl', 'acl')"
CLAUSES = f"""up(sent_id, i, cur) AS (SELECT sent_id, i, i FROM tok UNION ALL
        SELECT up.sent_id, up.i, t.head FROM up JOIN tok t ON t.sent_id = up.sent_id AND t.i = up.cur WHERE t.dep NOT IN {BOUNDARY} AND t.head <> t.i),
    clause AS (SELECT up.sent_id, up.i, up.cur AS head FROM up JOIN tok t ON t.sent_id = up.sent_id AND t.i = up.cur WHERE t.dep IN {BOUNDARY} OR t.head = t.i)"""
BELOW = """below(sent_id, top, i) AS (SELECT sent_id, i, i FROM tok UNION ALL
        SELECT b.sent_id, b.top, t.i FROM below b JOIN tok t ON t.sent_id = b.sent_id AND t.head = b.i AND t.i <> t.head)"""


def trees(spark: SparkSession) -> DataFrame:
    return noted_sentences(spark, SENTENCES)


@query("clause_heads_of_tokens", f"WITH RECURSIVE {TOK}, {CLAUSES} SELECT sent_id, CAST(i AS BIGINT) AS i, CAST(head AS BIGINT) AS clause FROM clause")
def clause_heads_of_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every token the head of its clause."""
    found = trees(spark).select("sent_id", F.posexplode(P.clause_of(F.col("tok"))).alias("i", "clause"))
    return found.select("sent_id", F.col("i").cast("long"), F.col("clause").cast("long"))


@query(
    "tree_shapes",
    f"""WITH RECURSIVE {TOK}, up(sent_id, cur, d) AS (SELECT sent_id, i, 0 FROM tok UNION ALL SELECT up.sent_id, t.head, d + 1 FROM up JOIN tok t ON t.sent_id = up.sent_id AND t.i = up.cur WHERE t.head <> t.i)
        SELECT sent_id, CAST(max(d) AS BIGINT) AS depth, any_value(n_roots) AS n_roots, any_value(n_heads) AS n_heads FROM up
        JOIN (SELECT sent_id, count(*) FILTER (dep = 'ROOT') AS n_roots, count(*) FILTER (dep = 'ROOT' OR (dep IN {BOUNDARY} AND pos IN ('VERB', 'AUX'))) AS n_heads FROM tok GROUP BY sent_id) USING (sent_id)
        GROUP BY sent_id""",
)
def tree_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, roots and clause heads of every tree."""
    tok = F.col("tok")
    return trees(spark).select("sent_id", P.tree_depth(tok).cast("long").alias("depth"), F.size(P.roots(tok)).cast("long").alias("n_roots"), F.size(P.clause_heads(tok)).cast("long").alias("n_heads"))


@query(
    "subtree_spans",
    f"""WITH RECURSIVE {TOK}, {BELOW} SELECT b.sent_id, CAST(b.top AS BIGINT) AS i, CAST(min(t.idx) AS BIGINT) AS span_start, CAST(max(t.idx + length(t.form)) AS BIGINT) AS span_end
        FROM below b JOIN tok t ON t.sent_id = b.sent_id AND t.i = b.i GROUP BY b.sent_id, b.top""",
)
def subtree_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character spans of every token's subtree."""
    tok = F.col("tok")
    found = trees(spark).select("sent_id", F.posexplode(F.transform(tok, lambda t: P.subtree_span(tok, t["i"]))).alias("i", "x"))
    return found.select("sent_id", F.col("i").cast("long"), F.col("x.start").cast("long").alias("span_start"), F.col("x.end").cast("long").alias("span_end"))


@query(
    "scope_targets",
    f"""WITH RECURSIVE {TOK}, up(sent_id, i, cur) AS (SELECT sent_id, i, i FROM tok UNION ALL
            SELECT up.sent_id, up.i, t.head FROM up JOIN tok t ON t.sent_id = up.sent_id AND t.i = up.cur WHERE t.dep NOT IN ('nsubj', 'nsubjpass', 'csubj', 'csubjpass') AND t.head <> t.i)
        SELECT up.sent_id, CAST(up.i AS BIGINT) AS i, CASE WHEN bool_or(t.dep IN ('nsubj', 'nsubjpass', 'csubj', 'csubjpass')) THEN 'subject' WHEN bool_or(up.i = t.i AND t.head = t.i) THEN 'clause' ELSE 'predicate' END AS scope_target
        FROM up JOIN tok t ON t.sent_id = up.sent_id AND t.i = up.cur GROUP BY up.sent_id, up.i""",
)
def scope_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each token stands in the subject, the predicate or heads the clause."""
    found = trees(spark).select("sent_id", F.posexplode(P.scope_targets(F.col("tok"))).alias("i", "scope_target"))
    return found.select("sent_id", F.col("i").cast("long"), "scope_target")


@query(
    "scope_ratios",
    f"""WITH RECURSIVE {TOK}, {CLAUSES} SELECT c.sent_id, CAST(c.head AS BIGINT) AS head, round(count(*) / any_value(n), 6) AS ratio FROM clause c JOIN (SELECT sent_id, count(*) AS n FROM tok GROUP BY sent_id) USING (sent_id)
        JOIN tok h ON h.sent_id = c.sent_id AND h.i = c.head WHERE h.dep = 'ROOT' OR h.pos IN ('VERB', 'AUX') GROUP BY c.sent_id, c.head""",
)
def scope_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of a sentence that each clause's scope holds."""
    tok = F.col("tok")
    found = trees(spark).select("sent_id", F.explode(F.transform(P.clause_heads(tok), lambda i: F.struct(i.alias("head"), P.scope_ratio(tok, i).alias("ratio")))).alias("x"))
    return found.select("sent_id", F.col("x.head").cast("long").alias("head"), F.round("x.ratio", 6).alias("ratio"))


@query(
    "sentence_flags",
    f"""WITH {TOK}, root AS (SELECT sent_id, min(i) AS r FROM tok WHERE dep = 'ROOT' GROUP BY sent_id)
        SELECT sent_id, CASE WHEN bool_or(dep IN ('auxpass', 'nsubjpass', 'csubjpass')) THEN 'passive' ELSE 'active' END AS voice, bool_or(dep IN ('advcl', 'ccomp', 'relcl', 'xcomp', 'acl')) AS has_subordinate,
            bool_or(dep = 'expl' AND lower = 'there') AS is_existential, bool_or(tag IN ('JJR', 'RBR') OR (lower = 'than' AND dep IN ('prep', 'mark', 'pcomp'))) AS is_comparative,
            bool_or(lower IN ('if', 'unless') AND dep = 'mark') AS is_conditional,
            coalesce(min_by(CASE WHEN lower IN ('can', 'could') THEN 'ability' WHEN lower IN ('may', 'might', 'will', 'would') THEN 'epistemic' ELSE 'deontic' END, i)
                FILTER (tag = 'MD' AND (head = r OR i = r) AND lower IN ('can', 'could', 'may', 'might', 'will', 'would', 'shall', 'should', 'must', 'ought', 'need')), 'none') AS modality
        FROM tok JOIN root USING (sent_id) GROUP BY sent_id""",
)
def sentence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every sentence's structure says: voice, modality and kinds of clauses."""
    p = P.profile(RELATION, F.col("tok"), F.col("text"))
    return trees(spark).select("sent_id", p.alias("p")).select("sent_id", *[f"p.{c}" for c in ("voice", "has_subordinate", "is_existential", "is_comparative", "is_conditional", "modality")])


# Read from the sentences: those that are no plain declaratives without a copula.
_KINDS = {6: ("imperative", "none"), 40: ("interrogative", "none"), 41: ("interrogative", "be"), 49: ("exclamative", "be"), 50: ("declarative", "become/seem/appear")}
_COPULAS = (11, 12, 13, 14, 15, 36, 38, 39, 42, 43, 47, 53, 56)


@query(
    "sentence_kinds",
    f"WITH {values('kinds', 'sent_id, clause_type, copula_type', [(str(n), *_KINDS.get(n, ('declarative', 'be' if n in _COPULAS else 'none'))) for n in range(len(SENTENCES))])} SELECT * FROM kinds",
)
def sentence_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause type and kind of copula."""
    return trees(spark).select("sent_id", P.clause_type(F.col("tok"), F.col("text")).alias("clause_type"), P.copula_type(F.col("tok")).alias("copula_type"))


# Read from the sentences: every cue as (sentence, place, text, family).
CUES = [
    (12, 3, "impossible", "D_affixal"), (14, 3, "unimportant", "D_affixal"), (17, 2, "lacks", "F_implicit"), (19, 3, "without", "G_prepositional"),
    (20, 2, "fails", "F_implicit"), (21, 1, "denies", "F_implicit"), (25, 0, "Not", "A_syntactic"), (26, 2, "not", "A_syntactic"), (27, 0, "No", "B_quantifier"),
    (28, 0, "Neither", "B_quantifier"), (29, 0, "No one", "B_quantifier"), (30, 1, "rarely", "C_neg_adverb"), (31, 1, "never", "C_neg_adverb"), (32, 3, "not", "A_syntactic"),
    (33, 3, "not", "A_syntactic"), (34, 3, "n't", "A_syntactic"), (35, 3, "not", "A_syntactic"), (36, 2, "not", "A_syntactic"), (37, 3, "not", "A_syntactic"),
    (37, 4, "fail", "F_implicit"), (38, 3, "unreliable", "D_affixal"), (39, 2, "not", "A_syntactic"), (39, 3, "unusual", "D_affixal"), (41, 3, "impossible", "D_affixal"),
    (45, 8, "not", "A_syntactic"), (51, 4, "not", "A_syntactic"), (52, 4, "not", "A_syntactic"), (54, 2, "never", "C_neg_adverb"), (54, 3, "fails", "F_implicit"),
    (55, 3, "not", "A_syntactic"), (55, 9, "not", "A_syntactic"), (56, 3, "not", "A_syntactic"), (56, 4, "impossible", "D_affixal"),
]


@query("sentence_cues", f"WITH {values('cues', 'sent_id, token_idx, cue_text, family', [(str(c[0]), *c[1:]) for c in CUES])} SELECT sent_id, CAST(token_idx AS BIGINT) AS token_idx, cue_text, family FROM cues")
def sentence_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cue with the family that it is of."""
    found = trees(spark).select("sent_id", F.explode(P.existing_cues(RELATION, F.col("tok"), F.col("text"))).alias("c"))
    return found.select("sent_id", F.col("c.token_idx").cast("long").alias("token_idx"), "c.cue_text", "c.family")


@query(
    "clause_frames",
    f"""WITH {TOK}, heads AS (SELECT h.*, (SELECT min(c.i) FROM tok c WHERE c.sent_id = h.sent_id AND c.head = h.i AND c.dep IN ('aux', 'auxpass')) AS aux,
            (SELECT min(c.i) FROM tok c WHERE c.sent_id = h.sent_id AND c.head = h.i AND c.dep IN ('nsubj', 'nsubjpass', 'expl')) AS subject FROM tok h WHERE h.dep = 'ROOT' OR (h.dep IN {BOUNDARY} AND h.pos IN ('VERB', 'AUX'))),
        owned AS (SELECT h.*, coalesce(h.subject, CASE WHEN h.dep = 'conj' THEN o.subject END) AS owner FROM heads h LEFT JOIN heads o ON o.sent_id = h.sent_id AND o.i = h.head AND o.i <> h.i)
        SELECT sent_id, CAST(i AS BIGINT) AS head, CASE WHEN aux IS NOT NULL THEN 'existing_aux' WHEN lemma = 'be' THEN 'copula' ELSE 'do_support' END AS subtype,
            CASE WHEN aux IS NULL AND lemma <> 'be' THEN CASE tag WHEN 'VBD' THEN 'did' WHEN 'VBZ' THEN 'does' ELSE 'do' END END AS do_form, CAST(coalesce(owner, -1) AS BIGINT) AS subject FROM owned
        WHERE pos IN ('VERB', 'AUX')""",
)
def clause_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each clause takes a negator; subject is -1 without one."""
    found = trees(spark).select("sent_id", F.explode(P.frames(F.col("tok"), P.clause_heads(F.col("tok")))).alias("x"))
    return found.select("sent_id", F.col("x.head").cast("long").alias("head"), "x.subtype", "x.do_form", F.coalesce("x.subject", F.lit(-1)).cast("long").alias("subject"))


_SHOWN = ["base_id", "generator", "subtype", "net_negation", "scope_target", "variant"]


@query(
    "parsed_variants",
    f"WITH {values('made', ', '.join(_SHOWN), [tuple(int(x) if k == 3 else x for k, x in enumerate(line.split(chr(9)))) for line in VARIANTS.splitlines()])} "
    "SELECT base_id, generator, subtype, CAST(net_negation AS BIGINT) AS net_negation, scope_target, variant FROM made",
)
def parsed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules make of every sentence."""
    made = generators.generate(trees(spark), RELATION).where(~F.col("generator").isin(TEMPLATES) | F.col("base_id").isin(TEMPLATE_SENTENCES))
    return made.select(*[F.col(c).cast("long") if c == "net_negation" else F.col(c) for c in _SHOWN])


@query("variant_cue_spans")
def variant_cue_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants whose cue spans don't hold their cues: none."""
    made = generators.generate(trees(spark), RELATION)
    read = F.transform("cue_char_spans", lambda s: F.substr(F.col("variant"), s["start"] + 1, s["end"] - s["start"]))
    return made.where((read != F.col("cue_tokens")) | (F.size("cue_tokens") != F.col("cue_count"))).select("base_id", "variant")


# Read from the sentences: equal texts of other rules that come earlier in the order of rules.
@query("parsed_variant_drops", "SELECT * FROM (VALUES ('duplicate', 14), ('kept', 745)) AS t(reason, n)")
def parsed_variant_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many variants each filter drops."""
    return filters.report(filters.tagged(generators.generate(trees(spark), RELATION)))


# Read from the sentences: the main reading of each affirmation.
_AFFIRMED = [
    (12, "The task is possible."), (14, "The result is important."), (17, "The system has redundancy."), (20, "The function manages to sort the array."), (21, "He admits taking the money."),
    (26, "Everyone passed the exam."), (27, "Some students passed."), (28, "Both tests passed."), (29, "Someone passed the exam."), (30, "He arrives early."), (31, "He calls."),
    (32, "The scheduler runs the process."), (33, "The kernel ran the job."), (34, "The process can access the memory."), (35, "The pages were loaded."), (36, "Delhi is the capital of India."),
    (37, "The function does not manage to sort the array."), (37, "The function fails to sort the array."), (38, "The protocol is reliable."), (39, "It is usual."),
    (45, "If the test passes, the build succeeds."), (51, "The function probably sorts the array."), (52, "The function definitely sorts the array."), (54, "The function fails to sort the array."),
    (54, "The function never manages to sort the array."), (55, "The function sorts the array and does not return the result."), (56, "The task is possible."),
]


@query("affirmations", f"WITH {values('made', 'sent_id, text', [(str(n), t) for n, t in _AFFIRMED])} SELECT sent_id, text FROM made")
def primary_affirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main readings of the sentences without one of their cues."""
    return affirmations.affirmations(trees(spark), RELATION).where("primary").select("sent_id", "text")


# polarity: SQL reads the cues above, with the clause that the recursion finds and the intensity by the words around

_FAMILY_WEIGHT = "CASE family WHEN 'F_implicit' THEN 0.8 WHEN 'D_affixal' THEN 0.7 WHEN 'G_prepositional' THEN 0.8 WHEN 'J_contrastive' THEN 0.8 ELSE 1.0 END"
_POLARITY = f"""{TOK}, {values('cue', 'sent_id, token_idx, cue_text, family', [*[(str(c[0]), *c[1:]) for c in CUES], ('53', 3, 'anything but', 'J_contrastive')])}, {CLAUSES},
    placed AS (SELECT cue.*, clause.head AS clause_head FROM cue JOIN clause ON clause.sent_id = cue.sent_id AND clause.i = cue.token_idx),
    weighed AS (SELECT *, CASE WHEN lower(cue_text) IN ('hardly', 'barely', 'rarely', 'seldom', 'scarcely') THEN 0.4
            WHEN EXISTS (SELECT 1 FROM clause c JOIN tok t ON t.sent_id = c.sent_id AND t.i = c.i WHERE c.sent_id = placed.sent_id AND c.head = placed.clause_head AND t.lower IN ('surely', 'definitely', 'certainly', 'absolutely')) THEN 1.0
            WHEN EXISTS (SELECT 1 FROM clause c JOIN tok t ON t.sent_id = c.sent_id AND t.i = c.i WHERE c.sent_id = placed.sent_id AND c.head = placed.clause_head AND t.lower IN ('maybe', 'possibly', 'probably', 'might', 'may')) THEN 0.6
            ELSE 0.9 END AS intensity FROM placed),
    by_clause AS (SELECT sent_id, clause_head, count(*) AS n, (1 - product(1 - 2 * intensity)) / 2 AS v3, (1 - product(1 - 2 * intensity * {_FAMILY_WEIGHT})) / 2 AS v4, max(intensity * {_FAMILY_WEIGHT}) AS top FROM weighed GROUP BY sent_id, clause_head)"""


def _polarity_sql(score: str) -> str:
    return f"WITH RECURSIVE {_POLARITY}, every AS (SELECT DISTINCT sent_id FROM tok) SELECT sent_id, round(CAST(coalesce(max({score}), 0) AS DOUBLE), 6) AS polarity FROM every LEFT JOIN by_clause USING (sent_id) GROUP BY sent_id"


def _polarity(spark: SparkSession, version: str) -> DataFrame:
    held = trees(spark).select("sent_id", Y.analysis(RELATION, F.col("tok"), F.col("text")).alias("cues"))
    return held.select("sent_id", F.round(Y.VERSIONS[version](F.col("cues")), 6).alias("polarity"))


@query("polarity_v1", _polarity_sql("CASE WHEN n > 0 THEN 1 END"))
def polarity_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 for a sentence with a cue."""
    return _polarity(spark, "v1")


@query("polarity_v2", _polarity_sql("n % 2"))
def polarity_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parity of cues by clause; the most negated clause speaks for the sentence."""
    return _polarity(spark, "v2")


@query("polarity_v3", _polarity_sql("v3"))
def polarity_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft exclusive-or of intensity weights by clause."""
    return _polarity(spark, "v3")


@query("polarity_v4", _polarity_sql("v4"))
def polarity_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft exclusive-or of family times intensity weights by clause."""
    return _polarity(spark, "v4")


@query("polarity_v5", _polarity_sql("CASE WHEN n % 2 = 1 THEN top ELSE 0 END"))
def polarity_v5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parity by clause first, then the weight of the strongest cue."""
    return _polarity(spark, "v5")


# Read from the pairs: (a, b, how grave the change is), and pairs of conditionals with what differs.
_SEVERITIES = [(0, 32, "flat"), (22, 27, "scope"), (0, 51, "hedged"), (0, 52, "intensified"), (13, 14, "lexical"), (16, 17, "lexical"), (18, 19, "flat"), (24, 26, "flat"), (11, 53, "flat"), (0, 1, "lexical")]


@query("pair_severity", f"WITH {values('s', 'a, b, severity', [(str(a), str(b), s) for a, b, s in _SEVERITIES])} SELECT * FROM s")
def pair_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How grave the change between two sentences is."""
    held = trees(spark).select("sent_id", "text", Y.analysis(RELATION, F.col("tok"), F.col("text")).alias("cues"))
    side = lambda x: held.select(F.col("sent_id").alias(x), F.col("text").alias(f"{x}_text"), F.col("cues").alias(f"{x}_cues"))
    asked = spark.createDataFrame([(str(a), str(b)) for a, b, _ in _SEVERITIES], "a string, b string")
    return asked.join(side("a"), "a").join(side("b"), "b").select("a", "b", Y.severity(F.col("a_cues"), F.col("b_cues"), F.col("b_text")).alias("severity"))


@query(
    "pair_cancellation",
    f"""WITH RECURSIVE {_POLARITY}, s AS (SELECT sent_id, coalesce(bool_or(n >= 2 AND n % 2 = 0), false) AS cancels, coalesce(max(n % 2), 0) AS v2 FROM (SELECT DISTINCT sent_id FROM tok) LEFT JOIN by_clause USING (sent_id) GROUP BY sent_id)
        SELECT a.sent_id AS a, b.sent_id AS b FROM s a, s b WHERE a.sent_id IN ('0', '37') AND a.sent_id <> b.sent_id AND b.cancels AND a.v2 = b.v2""",
)
def pair_cancellation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that cancel their own negation and have the same parity as an affirmative and as a cancelling one."""
    held = trees(spark).select("sent_id", Y.analysis(RELATION, F.col("tok"), F.col("text")).alias("cues"))
    first = held.where("sent_id IN ('0', '37')").select(F.col("sent_id").alias("a"), F.col("cues").alias("a_cues"))
    return held.join(F.broadcast(first), F.col("a") != F.col("sent_id")).where(Y.cancellation_detected(F.col("a_cues"), F.col("cues"))).select("a", F.col("sent_id").alias("b"))


@query(
    "conditional_spans",
    """SELECT * FROM (VALUES ('44', 'if', 'If the test passes', 'the build succeeds', NULL), ('45', 'if', 'If the test passes', 'the build does not succeed', 'negation')) AS t(sent_id, marker, antecedent, consequent, against_44)""",
)
def conditional_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditionals with the words of both halves, and what differs from the first one."""
    tok = F.col("tok")
    held = trees(spark).select("sent_id", "tok", Y.primary_conditional(Y.conditionals(tok)).alias("c"), Y.analysis(RELATION, tok, F.col("text")).alias("cues")).where("c IS NOT NULL")
    words = lambda span: F.array_join(F.transform(span, lambda i: P.token(tok, i)["text"]), " ")
    first = held.where("sent_id = '44'").select(F.col("c").alias("c0"), F.col("cues").alias("cues0"))
    decided = Y.conditional_decision(F.col("c0"), F.col("c"), F.col("cues0"), F.col("cues"))
    return held.join(F.broadcast(first)).select("sent_id", "c.marker", words(F.col("c.ante_span")).alias("antecedent"), words(F.col("c.cons_span")).alias("consequent"), decided.alias("against_44"))
