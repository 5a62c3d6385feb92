"""Variants of parsed sentences: every rule is an expression that turns a sentence into an array of candidate edits.

analysed() adds to each sentence what rules ask of it, once. generate() concatenates the candidates of all rules inside
the row, explodes them and splices the text: one projection and one explode, no join and no shuffle. Rules stand in the
order in which their variants win against equal later ones.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import lexicons, morphology, parsed as P, text as X
from tessera.functions.tables import among, looked_up, looked_up_list, rows
from tessera.operators.splice import EDITS, delete, edit, edits_of, insert, mark, piece, replace, spliced

CANDIDATES = (
    "array<struct<family:string,subtype:string,net_negation:int,scope_target:string,intensity_hint:string,"
    f"modality:string,clause_idx:int,removed:int,marks:array<int>,edits:{EDITS}>>"
)
PLACING = ("declarative", "imperative", "exclamative")
ANY = (*PLACING, "interrogative")


@dataclass(frozen=True)
class Rule:
    """A rule's name and family, what it does to its input, the clause types that it is licensed for, and its candidates."""

    name: str
    family: str
    build: Callable[["Rule", "Sentence"], Column]
    stage: int = 1
    operation: str = "negate"
    depth: int = 1
    op_depth: int = 1
    clause_types: tuple[str, ...] = PLACING

    def made(
        self, subtype: Column | str, edits: Column, net: Column | int = 1, scope: Column | str = "clause", hint: Column | str = "neutral", family: Column | None = None,
        modality: Column | None = None, clause: Column | None = None, removed: Column | None = None, marks: Column | None = None,
    ) -> Column:
        """A candidate; `marks` are the places of cues that stay, `removed` that of the cue that goes."""
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        none = lambda x, kind: F.lit(None).cast(kind) if x is None else x
        fields = {
            "family": F.lit(self.family) if family is None else family, "subtype": lit(subtype), "net_negation": lit(net), "scope_target": lit(scope), "intensity_hint": lit(hint),
            "modality": none(modality, "string"), "clause_idx": none(clause, "int"), "removed": none(removed, "int"), "marks": none(marks, "array<int>"), "edits": edits,
        }
        return F.struct(*[c.alias(n) for n, c in fields.items()])


class Sentence:
    """The columns of an analysed sentence."""

    def __init__(self, relation: P.Antonyms):
        self.relation = relation
        self.text, self.tok, self.profile, self.root, self.heads = (F.col(c) for c in ("text", "tok", "profile", "root", "heads"))
        self.frame, self.frames, self.explicit, self.lexical, self.quantified = (F.col(c) for c in ("frame", "frames", "explicit", "lexical", "quantified"))
        self.plain, self.be, self.derivable, self.stems, self.scope, self.targets = (F.col(c) for c in ("plain", "be", "derivable", "stems", "scope", "targets"))
        self.top = P.token(self.tok, self.root)
        self.cues = F.transform(self.profile["existing_cues"], lambda c: c["token_idx"])
        self.free = self.frame.isNotNull() & (F.size(self.explicit) == 0) & (F.size(self.lexical) == 0)
        self.affirmative = self.profile["polarity"] == "affirmative"

    def at(self, i: Column) -> Column:
        return P.token(self.tok, i)

    def double(self, i: Column) -> Column:
        """Family of a clausal negator at the root and a cue at a place."""
        return F.when(F.array_contains(self.scope, i), "K1_cancellation").otherwise("K2_compound")

    def target(self, i: Column) -> Column:
        return F.get(self.targets, i)

    def is_frame(self, subtype: str) -> Column:
        return F.coalesce(self.frame["subtype"] == subtype, F.lit(False))


def analysed(sentences: DataFrame, relation: P.Antonyms | None = None) -> DataFrame:
    """(sent_id, text, tok) with root, heads, profile, frame (of the root), frames (of all heads), explicit and lexical
    (places of cues in the root's clause), quantified (the root's subject, if it is), plain (edits of a clausal negator), be
    (its form for the subject), derivable (words that take a negative affix, with their forms), targets (scope_target of each token) and stems (for each token, what
    it negates by its affix). Nulls in tok give no rows."""
    relation = lexicons.prefixed_antonyms() if relation is None else relation
    tok = F.col("tok")
    held = sentences.where("tok IS NOT NULL AND size(tok) > 0").select("sent_id", "text", "tok")
    held = held.withColumns({"root": P.root(tok), "heads": P.clause_heads(tok), "profile": P.profile(relation, tok, F.col("text"))})
    held = held.withColumns({"frame": P.frame(tok, F.col("root")), "frames": P.frames(tok, F.col("heads")), "scope": P.clause_scope(tok, F.col("root")), "quantified": P.quantified_subject(tok)})
    eligible = F.transform(F.filter(tok, lambda t: P.affix_eligible(tok, t)), lambda t: F.struct(t.alias("t"), P.derived_forms(relation, t).alias("forms")))
    return held.withColumns({
        "explicit": P.explicit_negation(tok, F.col("scope")), "lexical": P.lexical_negatives(tok, F.col("scope")), "plain": negator(tok, F.col("frame")), "be": P.be_form(tok, F.col("frame")),
        "derivable": eligible, "targets": P.scope_targets(tok), "stems": F.transform(tok, lambda t: P.base_forms(relation, t)),
    })


# edits that rules share


def negator(tok: Column, held: Column, word: str = "not") -> Column:
    """A clausal negator in a frame's place: behind be or the auxiliary, or behind a do that is put before the verb."""
    slot, head = P.token(tok, held["slot"]), P.token(tok, held["head"])
    behind = F.array(insert(P.ends_at(slot), f" {word}", True))
    joined = F.array(replace(slot, "cannot", True))
    support = F.array(
        edit(held["at"], held["at"], piece(F.concat(held["do_form"], F.lit(" "))), piece(word, True), piece(" ")), replace(head, head["lemma"])
    )
    return F.when(held["subtype"] == "do_support", support).when((held["subtype"] == "existing_aux") & (slot["lower"] == "can") & F.lit(word == "not"), joined).otherwise(behind)


def _lower_first(t: Column) -> Column:
    return X.lower_initial(t["text"])


def _negator_out(tok: Column, neg: Column) -> Column:
    """Takes a negator out; an auxiliary that it was fused to gets its full form."""
    before = P.token(tok, F.greatest(neg["i"] - 1, F.lit(0)))
    fused = (neg["lower"] == "n't") & (neg["i"] > 0) & before["lower"].isin(list(lexicons.CONTRACTED_STEMS)) & (P.ends_at(before) == neg["idx"])
    whole = edit(before["idx"], P.ends_at(neg), piece(P.like(looked_up(lexicons.CONTRACTED_STEMS, before["lower"]), before["text"])))
    single = replace(neg, P.like(looked_up(lexicons.NEGATIVE_AUX_BASES, neg["lower"]), neg["text"]))
    return F.when(fused, whole).when(neg["lower"].isin(list(lexicons.NEGATIVE_AUX_BASES)), single).otherwise(delete(neg))


def _do_aux(tok: Column, neg: Column) -> Column:
    return P.first_child(tok, neg["head"], lambda c: c["dep"].isin(P.AUXILIARY) & c["lower"].isin(list(lexicons.DO_FORM_TAGS)))


def _plain_aux(tok: Column, neg: Column) -> Column:
    return P.first_child(tok, neg["head"], lambda c: c["dep"].isin(P.AUXILIARY) & ~c["lower"].isin(list(lexicons.DO_FORM_TAGS)))


def do_collapsed(tok: Column, neg: Column) -> Column:
    """Takes out a negator and its do, whose tense the verb gets back; in a question the do stays."""
    verb, aux = P.token(tok, neg["head"]), P.token(tok, _do_aux(tok, neg))
    inverted = F.coalesce(aux["i"] < P.subject(tok, verb["i"]), F.lit(False))
    back = replace(verb, morphology.inflect(verb["lemma"], looked_up(lexicons.DO_FORM_TAGS, aux["lower"])))
    return F.when(inverted, F.array(delete(neg))).otherwise(F.array(delete(aux), delete(neg), back))


def negator_removal(tok: Column, neg: Column) -> Column:
    """Edits that take a clausal negator out of its clause; null if it is none."""
    verb = P.token(tok, neg["head"])
    return (
        F.when(_do_aux(tok, neg) < neg["i"], do_collapsed(tok, neg))
        .when(_plain_aux(tok, neg) < neg["i"], F.array(_negator_out(tok, neg)))
        .when((verb["lemma"] == "be") & P.is_verbal(verb) & (neg["i"] > verb["i"]), F.array(delete(neg)))
    )


# negation


def _syntactic(subtype: str) -> Callable[[Rule, Sentence], Column]:
    return lambda rule, s: F.when(s.free & s.is_frame(subtype), F.array(rule.made(subtype, s.plain)))


def _quantifiers(rule: Rule, s: Sentence) -> Column:

    def one(t: Column) -> Column:
        to = looked_up(lexicons.QUANTIFIER_SWAPS, t["lower"])
        partitive = F.replace(to, F.lit(" the"), F.lit(""))
        held = F.when(F.coalesce(s.at(t["i"] + 1)["dep"] == "det", F.lit(False)), partitive).otherwise(to)
        subtype = F.concat(t["lower"], F.lit("_to_"), F.replace(partitive, F.lit(" "), F.lit("_")))
        return rule.made(subtype, F.array(replace(t, held, True)), scope=s.target(t["i"]))

    return F.transform(F.filter(s.tok, P.is_quantifier), one)


def _adverbs(rule: Rule, s: Sentence) -> Column:
    blocked = F.exists(s.tok, lambda t: among(t["lower"], [*lexicons.NEGATIVE_ADVERBS, "not", "no", "always", "n't"]))
    head, first, slot = s.at(s.frame["head"]), s.at(F.lit(0)), s.at(s.frame["slot"])

    def one(x: Column) -> Column:
        ahead = insert(head["idx"], F.concat(x["word"], F.lit(" ")), True)
        before = F.when(head["i"] == 0, F.array(ahead, replace(first, _lower_first(first)))).otherwise(F.array(ahead))
        behind = F.array(insert(P.ends_at(slot), F.concat(F.lit(" "), x["word"]), True))
        return rule.made(x["subtype"], F.when(s.is_frame("do_support"), before).otherwise(behind), hint=x["hint"])

    return F.when(s.free & ~blocked, F.transform(rows("word subtype hint", [(w, *v) for w, v in lexicons.NEGATIVE_ADVERBS.items()]), one))


def _affixes(rule: Rule, s: Sentence) -> Column:
    forms = lambda x: F.transform(
        x["forms"], lambda d: rule.made(d["subtype"], F.array(replace(x["t"], P.like(d["form"], x["t"]["text"]), True)), scope=s.target(x["t"]["i"]))
    )
    return F.flatten(F.transform(s.derivable, forms))


#: Antonyms put for a word at most, the first by sense.
MOST_ANTONYMS = 2


def _antonyms(rule: Rule, s: Sentence) -> Column:
    def of(t: Column) -> Column:
        words = F.transform(F.slice(P.antonyms_of(s.relation, t["lemma"], t["pos"]), 1, MOST_ANTONYMS), lambda w: P.fitted(w, t))
        return F.transform(
            F.filter(words, lambda w: F.lower(w) != t["lower"]),
            lambda w: rule.made(F.concat(F.lit("antonym_"), F.lower(t["pos"])), F.array(replace(t, w, True)), scope=s.target(t["i"])),
        )

    return F.flatten(F.transform(F.filter(s.tok, P.antonym_eligible), of))


def _triggers(rule: Rule, s: Sentence) -> Column:
    to = F.concat(F.lit(" to "), s.top["lemma"])

    def one(x: Column) -> Column:
        verb = piece(P.agreeing(x["lemma"], s.tok, s.frame), True)
        copular = F.array(piece(s.be), piece(" "), piece(x["predicate"], True), piece(to))
        gerund = F.array(verb, piece(F.concat(F.lit(" "), morphology.present_participle(s.top["lemma"]))))
        pieces = F.when(x["kind"] == "copular", copular).when(x["kind"] == "gerund", gerund).otherwise(F.array(verb, piece(to)))
        return rule.made(x["subtype"], F.array(edits_of(s.top["idx"], P.ends_at(s.top), pieces)))

    fit = F.filter(rows("lemma kind subtype predicate", lexicons.IMPLICIT_TRIGGERS), lambda x: (x["lemma"] != s.top["lemma"]) & ((x["kind"] != "copular") | s.frame["subject"].isNotNull()))
    return F.when(s.free & s.is_frame("do_support"), F.transform(fit, one))


def _lacks(rule: Rule, s: Sentence) -> Column:
    lemma, _, subtype, _ = lexicons.LACK_TRIGGER
    fits = s.free & s.is_frame("do_support") & s.top["lemma"].isin(lexicons.POSSESSION_VERBS) & P.has_object(s.tok, s.root)
    return F.when(fits, F.array(rule.made(subtype, F.array(replace(s.top, P.agreeing(F.lit(lemma), s.tok, s.frame), True)), scope="predicate")))


def _without(rule: Rule, s: Sentence) -> Column:
    preps = F.filter(s.tok, lambda t: (t["dep"] == "prep") & (t["lower"] == "with"))
    words = rows("words subtype", lexicons.WITH_REPLACEMENTS)
    each = lambda t: F.transform(words, lambda x: rule.made(x["subtype"], F.array(replace(t, x["words"], True)), scope=s.target(t["i"])))
    return F.when(F.size(P.explicit_negation(s.tok)) == 0, F.flatten(F.transform(preps, each)))


def _privative(rule: Rule, s: Sentence) -> Column:
    put = lambda x: edit(s.top["idx"], P.ends_at(s.top), piece(s.be), piece(" "), piece(x["words"], True))
    made = F.transform(rows("words subtype", lexicons.COPULAR_PRIVATIVES), lambda x: rule.made(x["subtype"], F.array(put(x)), scope="predicate"))
    return F.when(P.possession_object(s.tok).isNotNull() & s.is_frame("do_support") & (F.size(s.explicit) == 0), made)


def _modified(modifiers: list[tuple[str, str, str, list[str]]], hint: str) -> Callable[[Rule, Sentence], Column]:
    def build(rule: Rule, s: Sentence) -> Column:
        head, slot, at, support = s.at(s.frame["head"]), s.at(s.frame["slot"]), s.frame["at"], s.is_frame("do_support")
        bare, behind = replace(head, head["lemma"]), P.ends_at(slot)

        def one(x: Column) -> Column:
            word, spaced = piece(x["word"], True), F.concat(F.lit(" "), x["word"])
            modal = F.array(word, piece(" "), piece("not", True))
            do = F.array(word, piece(F.concat(F.lit(" "), s.frame["do_form"], F.lit(" "))), piece("not", True), piece(" "))
            ahead = F.array(edits_of(at, at, F.when(x["kind"] == "modal", F.concat(modal, F.array(piece(" ")))).otherwise(do)), bare)
            over = F.when(slot["tag"] == "MD", modal).otherwise(F.concat(modal, F.array(piece(F.concat(F.lit(" "), slot["lemma"])))))
            after = F.when(x["kind"] == "modal", F.array(edits_of(slot["idx"], behind, over))).when(
                x["kind"] == "adverb", F.array(edit(behind, behind, piece(spaced, True), piece(" not", True)))
            ).otherwise(F.array(insert(behind, spaced, True)))
            return rule.made(x["subtype"], F.when(support, ahead).otherwise(after), hint=hint)

        fit = F.filter(
            rows("word kind subtype fits", [(w, k, sub, " ".join(fits)) for w, k, sub, fits in modifiers]),
            lambda x: ((x["fits"] == "") | F.contains(x["fits"], s.frame["subtype"])) & ((x["kind"] != "post_aux") | ~support),
        )
        return F.when(s.free, F.transform(fit, one))

    return build


def _contrast(rule: Rule, s: Sentence) -> Column:
    at = P.copular_complement(s.tok)
    nominal = s.at(at)["pos"].isin("NOUN", "PROPN", "PRON")
    start = P.subtree_span(s.tok, at)["start"]
    put = lambda x: F.array(insert(start, F.concat(x["words"], F.lit(" ")), True))
    fit = F.filter(rows("words subtype", lexicons.CONTRASTIVE_FRAMES), lambda x: nominal | (x["subtype"] != "the_opposite_of"))
    return F.when(s.free & s.is_frame("copula") & at.isNotNull(), F.transform(fit, lambda x: rule.made(x["subtype"], put(x), scope="predicate")))


def _cancel_lexical(rule: Rule, s: Sentence) -> Column:
    word = F.get(s.lexical, 0)
    made = rule.made(F.concat(F.lit("cancel_"), s.at(word)["lower"]), s.plain, net=P.net_negation_of(s.double(word)), family=s.double(word), marks=F.array(word))
    return F.when(s.frame.isNotNull() & (F.size(s.explicit) == 0) & (F.size(s.lexical) > 0), F.array(made))


#: Words that a rule derives a negative from at most, in a sentence.
MOST_AFFIXES = 2


def _cancel_affixal(rule: Rule, s: Sentence) -> Column:
    targets = F.slice(F.filter(s.derivable, lambda x: F.array_contains(F.col("scope"), x["t"]["i"])), 1, MOST_AFFIXES)

    def forms(x: Column) -> Column:
        t = x["t"]
        family = s.double(t["i"])
        return F.transform(
            x["forms"],
            lambda d: rule.made(F.concat(F.lit("not_"), d["subtype"]), F.concat(s.plain, F.array(replace(t, d["form"], True))), net=P.net_negation_of(family), family=family),
        )

    return F.when(s.free, F.flatten(F.transform(targets, forms)))


def _cancel_trigger(rule: Rule, s: Sentence) -> Column:
    to = piece(F.concat(F.lit(" to "), s.top["lemma"]))

    def one(x: Column) -> Column:
        under = edit(s.top["idx"], P.ends_at(s.top), piece(P.agreeing(x["lemma"], s.tok, s.frame), True), to)
        subtype = F.concat(F.lit("never_"), x["subtype"])
        return rule.made(subtype, F.array(insert(s.top["idx"], "never ", True), under), net=P.net_negation_of(s.double(s.root)), family=s.double(s.root))

    fit = F.filter(rows("lemma kind subtype predicate", lexicons.IMPLICIT_TRIGGERS), lambda x: (x["kind"] == "to_inf") & (x["lemma"] != s.top["lemma"]))
    return F.when(s.free & s.is_frame("do_support") & (F.size(s.heads) <= 1) & (s.frame["at"] == s.top["idx"]), F.transform(fit, one))


def _no_explicit(s: Sentence, held: Column) -> Column:
    return F.size(P.explicit_negation(s.tok, P.clause_scope(s.tok, held["head"]))) == 0


def _two_clauses(rule: Rule, s: Sentence) -> Column:
    a, b = F.get(s.frames, 0), F.get(s.frames, 1)
    family = P.double_family(s.tok, a["head"], b["head"])
    made = rule.made(F.concat(a["subtype"], F.lit("+"), b["subtype"]), F.concat(negator(s.tok, a), negator(s.tok, b)), net=P.net_negation_of(family), family=family)
    return F.when((F.size(s.frames) >= 2) & (family == "K2_compound") & _no_explicit(s, a) & _no_explicit(s, b), F.array(made))


def _cross_clause(rule: Rule, s: Sentence) -> Column:
    def target(other: Column) -> Column:
        """The first word of another clause that has a negative derivation."""
        scope = P.clause_scope(s.tok, other["head"])
        return F.get(F.filter(s.derivable, lambda x: F.array_contains(scope, x["t"]["i"]) & (F.size(x["forms"]) > 0)), 0)

    def found(held: Column) -> Column:
        scope = P.clause_scope(s.tok, held["head"])
        others = F.array_compact(F.transform(F.filter(s.frames, lambda o: o["head"] != held["head"]), target))
        return F.when(P.is_affirmative(s.tok, scope) & (F.size(others) > 0), F.struct(held.alias("held"), F.get(others, 0).alias("word")))

    def made(pair: Column) -> Column:
        form, t = F.get(pair["word"]["forms"], 0), pair["word"]["t"]
        family = P.double_family(s.tok, pair["held"]["head"], t["i"])
        return rule.made(F.concat(F.lit("not+"), form["subtype"]), F.concat(negator(s.tok, pair["held"]), F.array(replace(t, form["form"], True))), net=P.net_negation_of(family), family=family)

    pairs = F.array_compact(F.transform(s.frames, found))
    return F.when(F.size(s.frames) >= 2, F.transform(F.slice(pairs, 1, 1), made))


def _preposed(s: Sentence, owner: Column) -> Column:
    """not before a subject, whose first word loses its capital."""
    first = s.at(F.array_min(P.subtree(s.tok, owner)))
    return edit(first["idx"], P.ends_at(first), piece("not ", True), piece(_lower_first(first)))


def _scope_readings(rule: Rule, s: Sentence) -> Column:
    subject = rule.made("subject_scope", F.array(_preposed(s, s.quantified)), scope="subject")
    predicate = rule.made("predicate_scope", s.plain, scope="predicate")
    return F.when(s.free & s.quantified.isNotNull(), F.array(subject, predicate))


def _question(rule: Rule, s: Sentence) -> Column:
    at, owner = P.fronted_aux(s.tok), P.subject(s.tok, s.root)
    aux = s.at(at)
    label = P.double_labelling(s.tok, s.root, s.cues)
    made = lambda subtype, edits: rule.made(subtype, edits, net=label["net_negation"], family=label["family"], marks=s.cues)
    behind = F.when(aux["dep"].isin(P.AUXILIARY), made("question_post_subject", F.array(insert(P.subject_end(s.tok, owner), " not", True))))
    short = morphology.contracted(aux["text"])
    fused = F.when(short.isNotNull(), made("question_contracted", F.array(replace(aux, short, True))))
    return F.when(at.isNotNull() & (F.size(s.explicit) == 0), F.array_compact(F.array(behind, fused)))


def _command(rule: Rule, s: Sentence) -> Column:
    head = s.at(s.frame["head"])
    dont = insert(head["idx"], "don't ", True)
    edits = F.when(head["i"] == 0, F.array(dont, replace(head, _lower_first(head)))).otherwise(F.array(dont))
    return F.when(s.affirmative & F.coalesce(s.frame["imperative"], F.lit(False)), F.array(rule.made("imperative_contracted", edits)))


def _existential(rule: Rule, s: Sentence) -> Column:
    what = P.existential_complement(s.tok)
    left = s.at(F.array_min(P.subtree(s.tok, what)))
    taken = left["dep"].isin(P.LEFT_EDGE) & (left["i"] < what)
    no = F.when(taken, replace(left, "no", True)).otherwise(insert(left["idx"], "no ", True))
    return F.when(s.affirmative & s.profile["is_existential"] & what.isNotNull(), F.array(rule.made("existential_no", F.array(no), scope="predicate")))


def _modal_readings(rule: Rule, s: Sentence) -> Column:
    modal = P.root_modal(s.tok, list(dict.fromkeys(r[0] for r in lexicons.MODAL_READINGS)))
    readings = rows("modal aux neg subtype modality", [(m, *surface.partition(" ")[::2], sub, kind) for m, surface, sub, _, kind in lexicons.MODAL_READINGS])

    def one(x: Column) -> Column:
        pieces = F.when(x["neg"] == "", F.array(piece(x["aux"], True))).otherwise(F.array(piece(x["aux"]), piece(" "), piece(x["neg"], True)))
        return rule.made(x["subtype"], F.array(edits_of(modal["idx"], P.ends_at(modal), pieces)), modality=x["modality"])

    return F.when(s.affirmative & (s.profile["modality"] != "none"), F.transform(F.filter(readings, lambda x: x["modal"] == modal["lower"]), one))


def _comparative(rule: Rule, s: Sentence) -> Column:
    at = P.comparative_head(s.tok)
    made = rule.made("no_comparative", F.array(insert(s.at(at)["idx"], "no ", True)), scope="predicate")
    return F.when(s.affirmative & s.profile["is_comparative"] & at.isNotNull(), F.array(made))


def _each_clause(rule: Rule, s: Sentence) -> Column:
    def made(held: Column) -> Column:
        label = P.double_labelling(s.tok, held["head"], s.cues)
        place = F.array_position(s.heads, held["head"]) - 1
        return rule.made(F.concat(F.lit("clause_"), held["subtype"]), negator(s.tok, held), net=label["net_negation"], family=label["family"], clause=place.cast("int"), marks=s.cues)

    return F.when(s.profile["clause_count"] >= 2, F.transform(F.filter(s.frames, lambda h: _no_explicit(s, h)), made))


# affirmation: one cue goes, the others stay and are marked


def _with_cue(rule: Rule, s: Sentence, then: Callable[[Column], Column]) -> Column:
    """The candidates that `then` makes of the token of the family's first cue; none without one."""
    first = F.slice(F.filter(s.profile["existing_cues"], lambda c: c["family"] == rule.family), 1, 1)
    return F.flatten(F.transform(F.transform(first, lambda c: s.at(c["token_idx"])), lambda cue: F.coalesce(then(cue), F.array().cast(CANDIDATES))))


def _affirmed(rule: Rule, s: Sentence, subtype: Column | str, edits: Column, cue: Column, scope: Column | str = "clause") -> Column:
    """net_negation counts the cues that stay, 2 at most."""
    left = F.filter(s.cues, lambda i: i != cue["i"])
    return rule.made(subtype, edits, net=F.least(F.size(left), F.lit(2)), scope=scope, removed=cue["i"], marks=left)


def _affirm_do(rule: Rule, s: Sentence) -> Column:
    def then(cue: Column) -> Column:
        fits = P.is_verbal(s.at(cue["head"])) & (_do_aux(s.tok, cue) < cue["i"])
        return F.when(fits, F.array(_affirmed(rule, s, "collapse_do_support", do_collapsed(s.tok, cue), cue)))

    return _with_cue(rule, s, then)


def _affirm_aux(rule: Rule, s: Sentence) -> Column:
    def then(cue: Column) -> Column:
        single = among(cue["lower"], lexicons.NEGATIVE_AUX_BASES)
        fits = P.is_verbal(s.at(cue["head"])) & _do_aux(s.tok, cue).isNull() & ((_plain_aux(s.tok, cue) < cue["i"]) | single)
        return F.when(fits, F.array(_affirmed(rule, s, "drop_aux_negator", F.array(_negator_out(s.tok, cue)), cue)))

    return _with_cue(rule, s, then)


def _affirm_copula(rule: Rule, s: Sentence) -> Column:
    def then(cue: Column) -> Column:
        head = s.at(cue["head"])
        main = (head["i"] == s.root) | ((head["dep"] == "conj") & (head["head"] == s.root))
        copula = (head["lemma"] == "be") & P.is_verbal(head) & P.finite_aux(s.tok, head["i"]).isNull()
        fits = (s.profile["copula_type"] == "be") & main & copula & (cue["i"] > head["i"])
        return F.when(fits, F.array(_affirmed(rule, s, "drop_copula_negator", F.array(delete(cue)), cue)))

    return _with_cue(rule, s, then)


def _affirm_quantifier(rule: Rule, s: Sentence) -> Column:
    def then(cue: Column) -> Column:
        after, noun = s.at(cue["i"] + 1), s.at(cue["head"])
        two = F.coalesce(*[F.when((cue["lower"] == a) & (after["lower"] == b), to) for (a, b), to in lexicons.QUANTIFIER_BIGRAMS.items()])
        to = F.coalesce(two, looked_up(lexicons.QUANTIFIER_FLIPS, cue["lower"]))
        swap = edit(cue["idx"], F.when(two.isNotNull(), P.ends_at(after)).otherwise(P.ends_at(cue)), piece(to))
        plural = (to == "both") & (noun["pos"] == "NOUN") & ~noun["tag"].isin("NNS", "NNPS")
        edits = F.when(plural, F.array(swap, replace(noun, P.like(morphology.third_person(noun["lemma"]), noun["text"])))).otherwise(F.array(swap))
        subtype = F.concat(cue["lower"], F.lit("_to_"), to)
        return F.when(to.isNotNull(), F.array(_affirmed(rule, s, subtype, edits, cue, s.target(cue["i"]))))

    return _with_cue(rule, s, then)


def _affirm_adverb(rule: Rule, s: Sentence) -> Column:
    def then(cue: Column) -> Column:
        name = lambda to: F.when(to == "", F.concat(F.lit("strip_"), cue["lower"])).otherwise(F.concat(cue["lower"], F.lit("_to_"), to))
        words = looked_up_list(lexicons.ADVERB_AFFIRMATIONS, cue["lower"])
        return F.transform(words, lambda to: _affirmed(rule, s, name(to), F.array(replace(cue, P.like(to, cue["text"]))), cue))

    return _with_cue(rule, s, then)


def _affirm_affix(rule: Rule, s: Sentence) -> Column:
    def then(cue: Column) -> Column:
        forms = F.transform(F.get(s.stems, cue["i"]), lambda d: F.struct(P.fitted(d["form"], cue).alias("word"), d["subtype"].alias("subtype")))
        new = F.filter(forms, lambda d: F.lower(d["word"]) != cue["lower"])
        return F.transform(new, lambda d: _affirmed(rule, s, F.concat(F.lit("strip_"), d["subtype"]), F.array(replace(cue, d["word"])), cue, s.target(cue["i"])))

    return _with_cue(rule, s, then)


def _affirm_implicit(rule: Rule, s: Sentence) -> Column:
    def then(cue: Column) -> Column:
        lemma = F.lower(cue["lemma"])
        owned = F.size(P.children(s.tok, cue["i"], lambda c: c["dep"].isin("dobj", "attr"))) > 0
        has = F.transform(
            F.filter(P.frames(s.tok, F.array(cue["i"])), lambda held: held["subtype"] == "do_support"),
            lambda held: _affirmed(rule, s, "lacks_to_has", F.array(replace(cue, P.agreeing(F.lit("have"), s.tok, held))), cue, "predicate"),
        )
        # the finite word is the be before unable, else the trigger itself
        copular = among(cue["lower"], P.TRIGGER_PREDICATES)
        finite = F.when(copular, s.at(P.finite_be(s.tok, cue["i"]))).otherwise(cue)
        inf, gerund = P.infinitive_below(s.tok, cue["i"]), P.gerund_below(s.tok, cue["i"])
        verb = s.at(F.when(copular, inf).when(among(lemma, P.TRIGGER_LEMMAS), F.coalesce(inf, gerund)))
        kind = F.when(copular, "copular").when(inf.isNotNull(), "to_inf").otherwise("gerund")
        cut = edit(F.least(finite["idx"], cue["idx"]), P.ends_at(verb), piece(morphology.inflect(verb["lemma"], finite["tag"])))
        promoted = F.array(_affirmed(rule, s, F.concat(F.lit("strip_"), kind), F.array(cut), cue))
        return F.when(lemma == lexicons.LACK_TRIGGER[0], F.when(owned, has)).when(verb.isNotNull() & finite.isNotNull(), promoted)

    return _with_cue(rule, s, then)


# the single negator moves


def _rescoped(s: Sentence) -> Column:
    return (s.profile["existing_count"] == 1) & (s.profile["clause_count"] == 1) & s.quantified.isNotNull()


def _to_predicate(rule: Rule, s: Sentence) -> Column:
    neg = s.at(P.preposed_negator(s.tok, s.quantified))
    made = rule.made("subject_to_predicate_scope", F.concat(F.array(delete(neg)), s.plain), scope="predicate")
    return F.when(_rescoped(s) & neg.isNotNull() & s.frame.isNotNull(), F.array(made))


def _to_subject(rule: Rule, s: Sentence) -> Column:
    negs = F.slice(P.children(s.tok, s.root, lambda c: (c["dep"] == "neg") & (c["i"] > s.quantified)), 1, 1)
    removals = F.filter(F.transform(negs, lambda neg: negator_removal(s.tok, neg)), lambda r: r.isNotNull())
    made = F.transform(removals, lambda r: rule.made("predicate_to_subject_scope", F.concat(F.array(_preposed(s, s.quantified)), r), scope="subject"))
    return F.when(_rescoped(s) & P.preposed_negator(s.tok, s.quantified).isNull(), made)


def _affirming(name: str, family: str, build: Callable[[Rule, Sentence], Column]) -> Rule:
    return Rule(name, family, build, stage=2, operation="affirm", clause_types=ANY)


RULES = [
    Rule("syn_copula_v1", "A_syntactic", _syntactic("copula")),
    Rule("syn_existing_aux_v1", "A_syntactic", _syntactic("existing_aux")),
    Rule("syn_do_support_v1", "A_syntactic", _syntactic("do_support")),
    _affirming("affirm_do_support_v1", "A_syntactic", _affirm_do),
    _affirming("affirm_aux_neg_v1", "A_syntactic", _affirm_aux),
    _affirming("affirm_copula_neg_v1", "A_syntactic", _affirm_copula),
    _affirming("affirm_quantifier_flip_v1", "B_quantifier", _affirm_quantifier),
    _affirming("affirm_neg_adverb_v1", "C_neg_adverb", _affirm_adverb),
    _affirming("affirm_affixal_strip_v1", "D_affixal", _affirm_affix),
    _affirming("affirm_implicit_strip_v1", "F_implicit", _affirm_implicit),
    Rule("quant_swap_v1", "B_quantifier", _quantifiers),
    Rule("negadv_insert_v1", "C_neg_adverb", _adverbs),
    Rule("affix_derive_v1", "D_affixal", _affixes),
    Rule("antonym_wordnet_v1", "E_antonym", _antonyms),
    Rule("implicit_trigger_v1", "F_implicit", _triggers),
    Rule("implicit_lack_v1", "F_implicit", _lacks),
    Rule("prep_without_v1", "G_prepositional", _without),
    Rule("prep_privative_copula_v1", "G_prepositional", _privative),
    Rule("hedge_wrap_v1", "H_hedged", _modified(lexicons.HEDGES, "hedged"), depth=2, op_depth=2),
    Rule("intensify_wrap_v1", "I_intensified", _modified(lexicons.INTENSIFIERS, "intensified"), depth=2, op_depth=2),
    Rule("contrastive_frame_v1", "J_contrastive", _contrast),
    Rule("k1_lexical_cancel_v1", "K1_cancellation", _cancel_lexical, depth=2),
    Rule("k1_affixal_cancel_v1", "K1_cancellation", _cancel_affixal, depth=2, op_depth=2),
    Rule("k1_trigger_cancel_v1", "K1_cancellation", _cancel_trigger, depth=2, op_depth=2),
    Rule("k2_clause_pair_v1", "K2_compound", _two_clauses, depth=2, op_depth=2),
    Rule("k2_cross_clause_v1", "K2_compound", _cross_clause, depth=2, op_depth=2),
    Rule("scope_position_v1", "L_scope_position", _scope_readings),
    Rule("interrogative_negation_v1", "A_syntactic", _question, stage=2, clause_types=("interrogative",)),
    Rule("imperative_contracted_v1", "A_syntactic", _command, stage=2, clause_types=("imperative",)),
    Rule("existential_no_v1", "B_quantifier", _existential, stage=2),
    Rule("modal_reading_v1", "M_modal", _modal_readings, stage=2),
    Rule("comparative_no_v1", "B_quantifier", _comparative, stage=2),
    Rule("clause_target_negation_v1", "A_syntactic", _each_clause, stage=2),
    Rule("rescope_subject_to_predicate_v1", "L_scope_position", _to_predicate, stage=2, operation="rescope", clause_types=ANY),
    Rule("rescope_predicate_to_subject_v1", "L_scope_position", _to_subject, stage=2, operation="rescope", clause_types=ANY),
]


def candidates(held: DataFrame, relation: P.Antonyms | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """analysed() rows with gen_ord, cand_ord and made (a candidate), one row for each candidate of the rules."""
    every = _every(tuple(RULES if rules is None else rules), tuple(lexicons.prefixed_antonyms() if relation is None else relation))
    return held.withColumn("x", F.explode(every)).select("*", "x.*").drop("x")


@functools.lru_cache(8)
def _every(rules: tuple[Rule, ...], relation: tuple[tuple[str, str, str], ...]) -> Column:
    """The candidates of all rules as one array; it is large, so it is put together once."""
    s = Sentence(list(relation))
    nothing = F.array().cast(CANDIDATES)

    def numbered(rule: Rule, place: int) -> Column:
        licensed = s.profile["clause_type"].isin(*rule.clause_types)
        found = F.coalesce(F.when(licensed, rule.build(rule, s)), nothing)
        return F.transform(found, lambda c, n: F.struct(F.lit(place).alias("gen_ord"), n.alias("cand_ord"), c.alias("made")))

    return F.concat(*[numbered(rule, k) for k, rule in enumerate(rules)])


def generate(sentences: DataFrame, relation: P.Antonyms | None = None, stages: tuple[int, ...] = (1, 2), rules: list[Rule] | None = None) -> DataFrame:
    """All variants of parsed sentences (sent_id, text, tok), before filters, as variant records with gen_ord and cand_ord.

    Variants equal to their sentence are left out. Sentences without tokens have none; equal sentences have equal variants.
    `relation` lists antonyms (lemma, part of speech, antonym) in the order of senses; by default those that affixes of the
    lexicon's negative words give.
    """
    chosen = [r for r in RULES if r.stage in stages] if rules is None else rules
    found = candidates(analysed(sentences, relation), relation, chosen)
    edits = mark(F.col("tok"), F.coalesce("made.marks", F.array().cast("array<int>")), F.col("made.edits"))
    found = found.withColumn("edits", edits).withColumn("done", spliced(F.col("text"), F.col("edits"))).where("done.variant <> trim(text)")
    spec = rows("generator depth operation op_depth", [(r.name, r.depth, r.operation, r.op_depth) for r in chosen])
    found = found.withColumn("rule", F.get(spec, F.col("gen_ord")))
    first = F.array_min(F.transform("edits", lambda e: e["at"]))
    return found.select(
        F.col("sent_id").alias("base_id"), F.col("text").alias("base_sentence"), "done.variant", "made.family", "made.subtype", "done.cue_tokens", "done.cue_char_spans",
        F.size("done.cue_tokens").alias("cue_count"), "made.net_negation", "made.scope_target", "made.intensity_hint", "rule.generator", F.col("rule.depth").cast("int").alias("depth"), "rule.operation",
        F.col("profile.polarity").alias("input_polarity"), F.col("profile.existing_count").alias("input_cue_count"), "profile.clause_type", "profile.voice",
        F.coalesce("made.modality", "profile.modality").alias("modality"), F.coalesce("made.clause_idx", P.clause_index_at(F.col("tok"), first)).alias("target_clause_idx"), F.col("rule.op_depth").cast("int").alias("op_depth"),
        F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("boolean").alias("verified"), "gen_ord", "cand_ord", F.col("made.removed").alias("removed"),
    )
