"""Affirmations of negated sentences: all readings that taking out one cue leaves, with what is known of each.

The readings of a sentence come in this order: a litotes (not un-X), implicit negatives that have a positive counterpart
or that promote what they embed, then the affirming rules of the generators. Of equal texts the first stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.functions import lexicons, morphology, parsed as P
from tessera.functions.tables import among, looked_up
from tessera.operators import filters
from tessera.operators.generators import RULES, Sentence, _negator_out, analysed, generate, negator_removal
from tessera.operators.splice import edit, piece, replace, spliced

FAMILY = "N_affirmation"
APPROXIMATE = ["hardly", "barely", "scarcely"]
READING = "sent_id string, text string, kind string, cue string, primary boolean, approximate boolean, polarity_flip boolean, rule string, family string, clause string"


def cue_type(tok: Column, t: Column, stems: Column) -> Column:
    """A readable type of a cue."""
    auxes = P.children(tok, t["head"], lambda c: c["dep"].isin(P.AUXILIARY) & (c["i"] < t["i"]))
    head = P.token(tok, t["head"])
    copula = (F.size(auxes) == 0) & (head["lemma"] == "be") & (head["i"] < t["i"])
    aux = F.when(F.size(auxes) > 0, F.get(auxes, F.size(auxes) - 1)).when(copula, head)
    lemma = F.lower(aux["lemma"])
    elsewhere = "not, other position (e.g. not + NP / adverb)"
    negator = (
        F.when((t["lower"] == "cannot") | aux["lower"].isin("ca", "can"), "can + not / can't / cannot")
        .when(aux.isNull(), elsewhere)
        .when(lemma == "do", F.when(aux["tag"] == "VBZ", "does not V").when(aux["tag"] == "VBD", "did not V").otherwise("do not V"))
        .when(lemma.isin("will", "wo"), "will not / won't")
        .when(lemma.isin("would", "should", "could", "must", "may", "might", "shall", "need"), "other modal + not")
        .when(lemma == "have", "has / have / had not (perfect)")
        .when(lemma == "be", F.when(copula, "be + not (copula)").otherwise("be + not (aux / passive / progressive)"))
        .otherwise(elsewhere)
    )
    own = F.lower(t["lemma"])
    implicit = among(own, [*lexicons.IMPLICIT_SWAPS, "lack", "unable"]) | (t["lower"] == "unable")
    return (
        F.when(t["lower"].isin("not", "n't", "cannot"), negator)
        .when(t["lower"] == "never", "never")
        .when(t["lower"].isin("rarely", "seldom", "hardly", "barely", "scarcely"), "rarely / seldom / hardly / barely")
        .when(among(t["lower"], lexicons.NEGATIVE_QUANTIFIERS), "negative quantifier (no / none / nobody / nothing / neither / nor)")
        .when(implicit, "implicit (refuse / deny / fail / lack / unable ...)")
        .when(F.endswith(t["lower"], F.lit("less")) & (t["pos"] == "ADJ"), "-less suffix")
        .when(F.size(F.get(stems, t["i"])) > 0, "affixal prefix (un- / in- / non- / dis- ...)")
        .when(t["lower"] == "without", "without")
        .otherwise(F.concat(F.lit("other ("), t["lower"], F.lit(")")))
    )


def strip_eligible(tok: Column, t: Column, stems: Column) -> Column:
    """Whether a negative affix may be taken off a token where it stands."""
    noun = F.exists(F.get(stems, t["i"]), lambda d: among(d["form"], lexicons.NOUN_STEMS))
    return (t["dep"] != "compound") & ~P.in_hyphens(tok, t) & F.when(t["pos"] == "NOUN", noun).otherwise(P.is_predicative(tok, t))


def _readings(s: Sentence, kinds: Column) -> tuple[Column, Column]:
    """Edits of the litotes and of implicit negatives: two arrays of (edits, kind, cue, approximate, flip, rule, clause)."""
    flip = lambda i: F.get(kinds, i).isin("main", "coordinated")

    def made(edits: Column, kind: Column | str, cue: Column, rule: Column | str, at: Column | None) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(
            edits.alias("edits"), lit(kind).alias("kind"), cue.alias("cue"), F.lit(at is None).alias("approximate"), (F.lit(False) if at is None else flip(at)).alias("flip"),
            lit(rule).alias("rule"), (F.lit("main") if at is None else F.get(kinds, at)).alias("clause"),
        )

    # litotes: the only negator of the main clause, over a word with a negative affix
    negs = F.filter(s.tok, lambda t: F.array_contains(s.scope, t["i"]) & t["lower"].isin("not", "n't", "never"))

    def understated(neg: Column) -> Column:
        affixed = F.filter(
            s.tok,
            lambda t: F.array_contains(s.scope, t["i"]) & t["pos"].isin("ADJ", "NOUN") & (F.size(F.get(s.stems, t["i"])) > 0)
            & ((t["i"] == neg["head"]) | (t["head"] == neg["head"])) & strip_eligible(s.tok, t, s.stems),
        )
        closest = F.slice(F.array_sort(affixed, lambda a, b: F.abs(a["i"] - neg["i"]) - F.abs(b["i"] - neg["i"])), 1, 1)
        removal = F.coalesce(negator_removal(s.tok, neg), F.array(_negator_out(s.tok, neg)))

        def one(x: Column) -> Column:
            word = replace(x, P.fitted(F.get(F.get(s.stems, x["i"]), 0)["form"], x))
            others = F.filter(removal, lambda e: ~((e["at"] <= x["idx"]) & (x["idx"] < e["until"])))
            return made(F.concat(others, F.array(word)), "litotes (not un-X)", F.concat(neg["text"], F.lit(" "), x["text"]), "litotes", None)

        return F.transform(closest, one)

    litotes = F.when(F.size(negs) == 1, F.flatten(F.transform(negs, understated)))

    # implicit negatives
    verbs = F.filter(s.tok, lambda t: F.get(kinds, t["i"]).isNotNull() & (t["pos"] == "VERB") & among(F.lower(t["lemma"]), [*lexicons.IMPLICIT_SWAPS, *lexicons.PROMOTE_ONLY]))

    def positive(t: Column) -> Column:
        lemma = F.lower(t["lemma"])
        to = looked_up(lexicons.IMPLICIT_SWAPS, lemma)
        embeds = ~among(lemma, lexicons.SWAPS_NEED_CLAUSE) | P.infinitive_below(s.tok, t["i"]).isNotNull()
        swapped = F.array(replace(t, P.like(morphology.inflect(to, t["tag"]), t["text"])))
        named = F.concat(F.lit("implicit_swap/"), lemma, F.lit("_to_"), to)
        verb = s.at(P.gerund_below(s.tok, t["i"]))
        promoted = F.array(edit(t["idx"], P.ends_at(verb), piece(morphology.inflect(verb["lemma"], t["tag"]))))
        return F.when(to.isNotNull() & embeds, made(swapped, cue_type(s.tok, t, s.stems), t["text"], named, t["i"])).when(
            to.isNull() & verb.isNotNull(), made(promoted, "implicit (avoid)", t["text"], F.concat(F.lit("implicit_promote/"), lemma), t["i"])
        )

    return litotes, F.array_compact(F.transform(verbs, positive))


def affirmations(sentences: DataFrame, relation: P.Antonyms | None = None, extended: bool = True) -> DataFrame:
    """One row per reading: sent_id, text, kind, cue, primary, approximate, polarity_flip, rule, family, clause.

    With extended, cues of coordinated, adverbial and complement clauses count too; only those of main and coordinated
    clauses flip the sentence. Beside a litotes no other reading is primary. Sentences without a cue have none.
    """
    s = Sentence(lexicons.prefixed_antonyms() if relation is None else relation)
    kinds = P.clause_kinds(F.col("tok")) if extended else F.transform("tok", lambda t: F.when(F.array_contains("scope", t["i"]), "main"))
    held = analysed(sentences, relation).withColumn("kinds", kinds)
    litotes, implicit = _readings(s, F.col("kinds"))
    own = held.withColumn("litotes", F.coalesce(litotes, F.slice(implicit, 1, 0))).withColumn("every", F.concat("litotes", implicit))
    lone = F.size("litotes") > 0
    own = own.select("sent_id", F.col("text").alias("base"), lone.alias("lone"), F.posexplode("every").alias("n", "x"))
    own = own.withColumn("done", spliced(F.col("base"), F.col("x.edits"))["variant"])
    first = own.select(
        "sent_id", "base", F.col("done").alias("text"), "x.kind", "x.cue", (~F.col("lone") | (F.col("x.rule") == "litotes")).alias("primary"), "x.approximate",
        F.col("x.flip").alias("polarity_flip"), "x.rule", F.lit(FAMILY).alias("family"), "x.clause", F.struct(F.lit(0).alias("part"), F.col("n"), F.lit(0).alias("c")).alias("place"),
    )
    made = filters.kept(generate(sentences, relation, rules=[r for r in RULES if r.operation == "affirm"])).where("removed IS NOT NULL")
    cue = P.token(F.col("tok"), F.col("removed"))
    known = held.select("sent_id", "tok", "stems", "kinds", F.coalesce(litotes, F.slice(implicit, 1, 0)).alias("litotes"))
    joined = made.withColumnRenamed("base_id", "sent_id").join(known, "sent_id").where(F.get("kinds", F.col("removed")).isNotNull())
    fit = (F.col("family") != "D_affixal") | strip_eligible(F.col("tok"), cue, F.col("stems"))
    second_best = ((F.col("family") == "C_neg_adverb") & ~F.col("subtype").startswith("strip_")) | ((F.col("family") == "F_implicit") & among(F.lower(cue["lemma"]), lexicons.IMPLICIT_SWAPS))
    second = joined.where(fit).select(
        "sent_id", F.col("base_sentence").alias("base"), F.col("variant").alias("text"), cue_type(F.col("tok"), cue, F.col("stems")).alias("kind"), cue["text"].alias("cue"),
        (~second_best & (F.size("litotes") == 0)).alias("primary"), ((F.col("family") == "C_neg_adverb") & cue["lower"].isin(APPROXIMATE)).alias("approximate"),
        F.get("kinds", F.col("removed")).isin("main", "coordinated").alias("polarity_flip"), F.concat_ws("/", "generator", "subtype").alias("rule"), F.lit(FAMILY).alias("family"),
        F.get("kinds", F.col("removed")).alias("clause"), F.struct(F.lit(1).alias("part"), F.col("gen_ord").alias("n"), F.col("cand_ord").alias("c")).alias("place"),
    )
    order = F.row_number().over(W.partitionBy("sent_id", "text").orderBy("place"))
    return first.unionByName(second).where("text <> base").withColumn("nth", order).where("nth = 1").drop("nth", "place", "base")


def failure_reasons(sentences: DataFrame, relation: P.Antonyms | None = None, extended: bool = True) -> DataFrame:
    """(sent_id, reason) of the sentences that have no affirmation, in named buckets."""
    held = analysed(sentences, relation)
    kinds = P.clause_kinds(F.col("tok")) if extended else F.transform("tok", lambda t: F.when(F.array_contains("scope", t["i"]), "main"))
    held = held.withColumn("kinds", kinds).join(affirmations(sentences, relation, extended).select("sent_id").distinct(), "sent_id", "left_anti")
    inside = F.filter("profile.existing_cues", lambda c: F.get("kinds", c["token_idx"]).isNotNull())
    cue = F.get(inside, 0)
    t = P.token(F.col("tok"), cue["token_idx"])
    bare = t["lower"].isin("not", "n't") & (F.size(P.children(F.col("tok"), t["head"], lambda c: c["dep"].isin(P.AUXILIARY))) == 0) & (P.token(F.col("tok"), t["head"])["lemma"] != "be")
    outside = (
        "every cue is in a relative clause or attached to a noun phrase (not an affirmable clause)" if extended else "every cue is outside the main clause (relative / subordinate / coordinated clause)"
    )
    reason = (
        F.when(F.size("profile.existing_cues") == 0, "no cue the generator's classifier recognises")
        .when(F.size(inside) == 0, outside)
        .when((cue["family"] == "D_affixal") & among(t["lower"], lexicons.AFFIXAL_BLOCKLIST), "affixal: on the exception blocklist")
        .when(cue["family"] == "D_affixal", "affixal: attributive / term position (step-0.1 rule) or no WordNet-attested stem")
        .when((cue["family"] == "A_syntactic") & bare, "not without an auxiliary to hang on (not + NP / adverb / infinitive)")
        .when(cue["family"] == "A_syntactic", "syntactic negator: parse shape the removal rules do not cover")
        .when(cue["family"] == "B_quantifier", "negative quantifier: no flip for this form or position")
        .when(cue["family"] == "F_implicit", "implicit trigger: no complement to promote / not in the swap lexicon")
        .when(cue["family"] == "C_neg_adverb", "negative adverb: removal rejected by the filters")
        .otherwise(F.concat(F.lit("cue family "), cue["family"], F.lit(": no affirmation rule")))
    )
    return held.select("sent_id", reason.alias("reason"))
