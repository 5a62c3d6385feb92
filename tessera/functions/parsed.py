"""Functions of parsed sentences: a tree is an array of tokens, each with the place of its head.

Everything is a column expression over that array. What follows heads upward (clauses, subtrees, depth) jumps pointers:
every step doubles the distance, so that a sentence of n tokens takes log2(n) steps, and all tokens step at once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from tessera.functions import lexicons, morphology
from tessera.functions.tables import among, looked_up, looked_up_list

TOKEN = (
    "struct<i:int,idx:int,text:string,lower:string,lemma:string,pos:string,tag:string,dep:string,head:int,"
    "tense:string,person:string,number:string,is_alpha:boolean,is_punct:boolean,is_stop:boolean>"
)
Test = Callable[[Column], Column]

# Labels of the dependency scheme.
BOUNDARIES = ["conj", "advcl", "ccomp", "csubj", "csubjpass", "parataxis", "relcl", "acl"]
AUXILIARY = ["aux", "auxpass"]
SUBJECTS = ["nsubj", "nsubjpass", "expl"]
SUBJECT_PARTS = ["nsubj", "nsubjpass", "csubj", "csubjpass"]
PREDICATIVE = ["acomp", "attr", "oprd"]
SUBORDINATE = ["advcl", "ccomp", "relcl", "xcomp", "acl"]
PREVERBAL = ["advmod", "neg", "npadvmod"]
LEFT_EDGE = ["det", "predet", "nummod"]
QUANTIFIER_ROLES = ["det", "predet", "nsubj", "nsubjpass", "dobj", "pobj", "advmod", "attr", "npadvmod", "nummod"]
AFFIX_ROLES = ["acomp", "attr", "oprd", "xcomp", "ccomp", "ROOT"]
SEEMING = ["become", "seem", "appear"]


# walking the array


def token(tok: Column, i: Column) -> Column:
    """The token at a place; null beyond the ends."""
    return F.get(tok, i)


def places(tok: Column, test: Test) -> Column:
    """Places of the tokens that pass, in order."""
    return F.transform(F.filter(tok, test), lambda t: t["i"])


def children(tok: Column, i: Column, test: Test = lambda t: F.lit(True)) -> Column:
    """The tokens whose head is at i, in order, of those that pass."""
    return F.filter(tok, lambda t: (t["head"] == i) & (t["i"] != i) & test(t))


def first_child(tok: Column, i: Column, test: Test) -> Column:
    """Place of the first child that passes; null without one."""
    return F.get(children(tok, i, test), 0)["i"]


def is_verbal(t: Column) -> Column:
    return t["pos"].isin("VERB", "AUX")


def ends_at(t: Column) -> Column:
    """Offset behind the token."""
    return t["idx"] + F.length(t["text"])


def _jumped(start: Column) -> Column:
    """Where pointers lead in the end; start holds for each place its own or the next place on its way."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(start) + 1)).cast("int"))
    return F.aggregate(steps, start, lambda at, _: F.transform(at, lambda x: F.get(at, x)))


def nearest(tok: Column, stops: Test) -> Column:
    """For each place the nearest ancestor, itself included, that passes; the top of its tree if none does."""
    return _jumped(F.transform(tok, lambda t: F.when(stops(t) | (t["head"] == t["i"]), t["i"]).otherwise(t["head"])))


def _led_to(found: Column, i: Column) -> Column:
    """Places whose pointer is i."""
    return F.array_compact(F.transform(found, lambda x, k: F.when(x == i, k)))


# trees


def roots(tok: Column) -> Column:
    return places(tok, lambda t: t["dep"] == "ROOT")


def root(tok: Column) -> Column:
    """Place of the first root; null without one."""
    return F.get(roots(tok), 0)


def finite_aux(tok: Column, i: Column) -> Column:
    """Place of the leftmost auxiliary of a verb."""
    return first_child(tok, i, lambda t: t["dep"].isin(AUXILIARY))


def subject(tok: Column, i: Column) -> Column:
    """Place of a verb's first subject."""
    return first_child(tok, i, lambda t: t["dep"].isin(SUBJECTS))


def subtree(tok: Column, i: Column) -> Column:
    """Places of a token and all below it, in order."""
    return _led_to(nearest(tok, lambda t: t["i"] == i), i)


def subtree_span(tok: Column, i: Column) -> Column:
    """(start, end) offsets of a subtree."""
    held = subtree(tok, i)
    return F.struct(token(tok, F.array_min(held))["idx"].alias("start"), ends_at(token(tok, F.array_max(held))).alias("end"))


def clause_scope(tok: Column, i: Column) -> Column:
    """Places of a head's own clause: below it without a clause boundary between."""
    return _led_to(nearest(tok, lambda t: (t["i"] == i) | among(t["dep"], BOUNDARIES)), i)


def clause_of(tok: Column) -> Column:
    """For each token the place of its clause's head."""
    return nearest(tok, lambda t: among(t["dep"], BOUNDARIES))


def clause_heads(tok: Column) -> Column:
    """Places of the heads of verbal clauses, in order."""
    return places(tok, lambda t: (t["dep"] == "ROOT") | (among(t["dep"], BOUNDARIES) & is_verbal(t)))


def clause_index_at(tok: Column, offset: Column) -> Column:
    """Which of the clause heads governs the token at or after an offset; 0 if none does."""
    heads = clause_heads(tok)
    at = F.coalesce(F.get(places(tok, lambda t: ends_at(t) > offset), 0), F.size(tok) - 1)
    governor = F.get(nearest(tok, lambda t: F.array_contains(heads, t["i"])), at)
    place = F.array_position(heads, governor)
    return F.greatest(F.when(place > 0, place).otherwise(F.array_position(heads, root(tok))) - 1, F.lit(0)).cast("int")


def tree_depth(tok: Column) -> Column:
    """Length of the longest chain of heads; -1 if heads run in a circle."""
    start = F.transform(tok, lambda t: F.struct(t["head"].alias("at"), F.when(t["head"] == t["i"], 0).otherwise(1).alias("d")))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(tok) + 1)).cast("int"))
    further = lambda at, x: F.get(at, x["at"])
    last = F.aggregate(steps, start, lambda at, _: F.transform(at, lambda x: F.struct(further(at, x)["at"].alias("at"), (x["d"] + further(at, x)["d"]).alias("d"))))
    loose = F.exists(last, lambda x: token(tok, x["at"])["head"] != x["at"])
    return F.when(loose, -1).otherwise(F.coalesce(F.array_max(F.transform(last, lambda x: x["d"])), F.lit(0)))


def is_tree(tok: Column, base_depth: Column) -> Column:
    """One root, no circle, and not more than 3 levels off the base's depth."""
    depth = tree_depth(tok)
    return (F.size(roots(tok)) == 1) & (depth >= 0) & (F.abs(depth - base_depth) <= 3)


def scope_target(tok: Column, i: Column) -> Column:
    """subject for what stands below a subject, clause for a root, else predicate."""
    top = token(tok, F.get(nearest(tok, lambda t: t["dep"].isin(SUBJECT_PARTS) | (t["dep"] == "ROOT")), i))
    return F.when(top["dep"].isin(SUBJECT_PARTS), "subject").when(top["i"] == i, "clause").otherwise("predicate")


def scope_targets(tok: Column) -> Column:
    """scope_target() of every token."""
    found = nearest(tok, lambda t: t["dep"].isin(SUBJECT_PARTS) | (t["dep"] == "ROOT"))
    named = lambda x, i: F.when(token(tok, x)["dep"].isin(SUBJECT_PARTS), "subject").when(x == i, "clause").otherwise("predicate")
    return F.transform(found, named)


def double_family(tok: Column, outer: Column, inner: Column) -> Column:
    """Family of two cues: a cancellation if the inner one is in the outer one's clause, else a compound."""
    return F.when(F.array_contains(clause_scope(tok, outer), inner), "K1_cancellation").otherwise("K2_compound")


def net_negation_of(family: Column) -> Column:
    return F.when(family == "K1_cancellation", 0).when(family == "K2_compound", 2)


def double_labelling(tok: Column, anchor: Column, existing: Column, family: str = "A_syntactic") -> Column:
    """(family, net_negation) of one more cue at `anchor` beside the existing ones (places); the own family and 1 without any."""
    double = double_family(tok, anchor, F.get(existing, 0))
    return F.when(F.size(existing) == 0, F.struct(F.lit(family).alias("family"), F.lit(1).alias("net_negation"))).otherwise(
        F.struct(double.alias("family"), net_negation_of(double).alias("net_negation"))
    )


def scope_ratio(tok: Column, i: Column) -> Column:
    """Part of the sentence's tokens that a head's clause holds."""
    return F.size(clause_scope(tok, i)) / F.size(tok)


def clause_kinds(tok: Column) -> Column:
    """For each token main, coordinated, advcl or ccomp, by its clause; null where a clause can't be affirmed on its own."""
    clause = clause_of(tok)
    # a chain of coordinated verbs that leads to the root
    coordinated = nearest(tok, lambda t: ~((t["dep"] == "conj") & (t["pos"].isin("VERB", "AUX", "ADJ"))))
    top = root(tok)
    main = lambda i: F.get(coordinated, i) == top
    head = lambda k: token(tok, F.get(clause, k))
    adverbial = lambda h: h["dep"].isin("advcl", "ccomp") & h["pos"].isin("VERB", "AUX", "ADJ") & main(h["head"])
    return F.transform(
        tok,
        lambda t: F.when(head(t["i"])["i"] == top, "main").when(main(head(t["i"])["i"]), "coordinated").when(adverbial(head(t["i"])), head(t["i"])["dep"]),
    )


# polarity of what a clause holds already


def _held(tok: Column, scope: Column | None, test: Test) -> Column:
    return places(tok, test if scope is None else lambda t: test(t) & F.array_contains(scope, t["i"]))


def explicit_negation(tok: Column, scope: Column | None = None) -> Column:
    """Places of overt cues."""
    return _held(tok, scope, lambda t: among(t["lower"], lexicons.EXPLICIT_CUES) | (t["dep"] == "neg"))


def lexical_negatives(tok: Column, scope: Column | None = None) -> Column:
    """Places of words that are negative themselves."""
    return _held(tok, scope, lambda t: among(t["lower"], lexicons.LEXICALLY_NEGATIVE) | among(F.lower(t["lemma"]), lexicons.LEXICALLY_NEGATIVE))


def is_affirmative(tok: Column, scope: Column | None = None) -> Column:
    return (F.size(explicit_negation(tok, scope)) == 0) & (F.size(lexical_negatives(tok, scope)) == 0)


# antonyms and affixes

Antonyms = list[tuple[str, str, str]]  # lemma, part of speech, antonym; in the order of senses


def antonyms_of(relation: Antonyms, lemma: Column, pos: Column) -> Column:
    """The antonyms of a lemma in their order; an empty array for unknown ones."""
    held: dict[str, list[str]] = {}
    for word, part, other in relation:
        held.setdefault(f"{part}:{word}", []).append(other)
    part = F.when(pos == "AUX", "VERB").otherwise(pos)
    return F.coalesce(looked_up_list(held, F.concat(part, F.lit(":"), F.lower(lemma))), F.array().cast("array<string>"))


def is_negative_derivative(relation: Antonyms, stem: Column, derived: Column, pos: Column) -> Column:
    """Whether the two are antonyms, either way, and the derived word is no exception."""
    linked = F.array_contains(antonyms_of(relation, stem, pos), derived) | F.array_contains(antonyms_of(relation, derived, pos), stem)
    return linked & ~among(derived, lexicons.AFFIXAL_BLOCKLIST)


def _word(t: Column) -> Column:
    return F.when(t["pos"] == "NOUN", F.lower(t["lemma"])).otherwise(t["lower"])


def _prefixes(word: Column, made: Callable[[Column, Column], Column]) -> Column:
    """made(prefix, onset) for every negative prefix, null ones left out; onset holds the letters that it needs, empty for any."""
    rows = F.from_json(F.lit(json.dumps([{"p": p, "onset": lexicons.PREFIX_ONSETS.get(p, "")} for p in lexicons.NEGATIVE_PREFIXES])), "array<struct<p:string,onset:string>>")
    return F.array_compact(F.transform(rows, lambda x: made(x["p"], x["onset"])))


def _onset_fits(onset: Column, stem: Column) -> Column:
    return (onset == "") | F.contains(onset, F.substr(stem, F.lit(1), F.lit(1)))


def _form(form: Column, kind: Column) -> Column:
    return F.struct(form.alias("form"), kind.alias("subtype"))


def derived_forms(relation: Antonyms, t: Column) -> Column:
    """Negative derivations of a token as (form, subtype), those that are its antonyms."""
    stem = _word(t)

    def prefixed(p: Column, onset: Column) -> Column:
        form = F.concat(p, stem)
        fits = _onset_fits(onset, stem) & ~F.startswith(stem, p) & is_negative_derivative(relation, stem, form, t["pos"])
        return F.when(fits, _form(form, F.concat(F.lit("prefix_"), p)))

    less = F.concat(F.substr(stem, F.lit(1), F.length(stem) - 3), F.lit("less"))
    full = (t["pos"] == "ADJ") & F.endswith(stem, F.lit("ful")) & (F.length(stem) > 4) & is_negative_derivative(relation, stem, less, t["pos"])
    return F.concat(_prefixes(stem, prefixed), F.array_compact(F.array(F.when(full, _form(less, F.lit("suffix_less"))))))


def base_forms(relation: Antonyms, t: Column) -> Column:
    """Stems that a token negates by its affix, as (form, subtype)."""
    word = _word(t)

    def stripped(p: Column, onset: Column) -> Column:
        stem = F.substr(word, F.length(p) + 1)
        fits = F.startswith(word, p) & (F.length(stem) >= 3) & _onset_fits(onset, stem) & is_negative_derivative(relation, stem, word, t["pos"])
        return F.when(t["is_alpha"] & fits, _form(stem, F.concat(F.lit("prefix_"), p)))

    full = F.concat(F.substr(word, F.lit(1), F.length(word) - 4), F.lit("ful"))
    less = t["is_alpha"] & (t["pos"] == "ADJ") & F.endswith(word, F.lit("less")) & (F.length(word) > 5) & is_negative_derivative(relation, full, word, t["pos"])
    return F.concat(_prefixes(word, stripped), F.array_compact(F.array(F.when(less, _form(full, F.lit("suffix_less"))))))


def is_predicative(tok: Column, t: Column) -> Column:
    """Whether a token is said of something: by its role, or by that of the adjective that it is joined to."""
    joined = nearest(tok, lambda x: ~((x["dep"] == "conj") & (token(tok, x["head"])["pos"] == "ADJ")))
    return token(tok, F.get(joined, t["i"]))["dep"].isin(AFFIX_ROLES)


def in_hyphens(tok: Column, t: Column) -> Column:
    return F.coalesce(F.when(t["i"] > 0, token(tok, F.greatest(t["i"] - 1, F.lit(0)))["text"] == "-"), F.lit(False)) | F.coalesce(token(tok, t["i"] + 1)["text"] == "-", F.lit(False))


def affix_eligible(tok: Column, t: Column) -> Column:
    """Whether a token may take a negative affix where it stands."""
    positive = ~among(t["lower"], lexicons.LEXICALLY_NEGATIVE) & ~among(F.lower(t["lemma"]), lexicons.LEXICALLY_NEGATIVE)
    sound = t["pos"].isin("ADJ", "NOUN") & ~t["tag"].isin("JJR", "JJS") & t["is_alpha"] & (F.length(t["text"]) >= 4) & positive
    free = (t["dep"] != "compound") & ~in_hyphens(tok, t)
    return sound & free & F.when(t["pos"] == "NOUN", among(F.lower(t["lemma"]), lexicons.NOUN_STEMS)).otherwise(is_predicative(tok, t))


def antonym_eligible(t: Column) -> Column:
    """Whether antonyms are put for a token."""
    positive = ~among(t["lower"], lexicons.LEXICALLY_NEGATIVE) & ~among(F.lower(t["lemma"]), lexicons.LEXICALLY_NEGATIVE)
    content = t["pos"].isin("ADJ", "VERB", "ADV") & ~t["tag"].isin("JJR", "JJS", "RBR", "RBS") & t["is_alpha"] & ~t["is_stop"]
    return content & positive & ~among(t["lower"], lexicons.ANTONYM_WORD_STOPS) & ~((t["pos"] == "VERB") & among(F.lower(t["lemma"]), lexicons.ANTONYM_VERB_STOPS))


def fitted(lemma: Column, t: Column) -> Column:
    """A lemma in the inflection and with the capital of the token that it replaces."""
    plural = (t["pos"] == "NOUN") & t["tag"].isin("NNS", "NNPS")
    form = F.when(is_verbal(t), morphology.inflect(lemma, t["tag"])).when(plural, morphology.third_person(lemma)).otherwise(lemma)
    return like(form, t["text"])


def like(word: Column, model: Column) -> Column:
    """A word with a capital if the model has one."""
    capital = model.rlike(r"^\p{Lu}")
    return F.when(capital, F.concat(F.upper(F.substr(word, F.lit(1), F.lit(1))), F.substr(word, F.lit(2)))).otherwise(word)


# cues


def is_privative(tok: Column, t: Column) -> Column:
    has_of = F.exists(tok, lambda c: (c["head"] == t["i"]) & (c["lower"] == "of"))
    return t["lower"].isin(lexicons.PRIVATIVE_HEADS) & (~t["lower"].isin(lexicons.PRIVATIVE_NEEDS_OF) | has_of)


TRIGGER_LEMMAS = [x[0] for x in lexicons.IMPLICIT_TRIGGERS if x[0] != "be"] + [lexicons.LACK_TRIGGER[0]]
TRIGGER_PREDICATES = [x[3] for x in lexicons.IMPLICIT_TRIGGERS if x[3]]


def is_implicit_trigger(tok: Column, t: Column) -> Column:
    embeds = F.exists(tok, lambda c: (c["head"] == t["i"]) & c["dep"].isin("xcomp", "ccomp", "acomp"))
    return (is_verbal(t) & among(F.lower(t["lemma"]), TRIGGER_LEMMAS)) | (t["lower"].isin(TRIGGER_PREDICATES) & embeds)


def cue_family(relation: Antonyms, tok: Column, t: Column) -> Column:
    """The family that a token is a cue of, by the first rule that holds; null for other words."""
    syntactic = among(t["lower"], ["not", "n't", "nt", *lexicons.NEGATIVE_AUX_BASES]) | (t["dep"] == "neg")
    return (
        F.when(among(t["lower"], list(lexicons.NEGATIVE_ADVERBS)), "C_neg_adverb")
        .when(among(t["lower"], lexicons.NEGATIVE_QUANTIFIERS), "B_quantifier")
        .when(syntactic, "A_syntactic")
        .when(is_privative(tok, t), "G_prepositional")
        .when(is_implicit_trigger(tok, t), "F_implicit")
        .when(F.size(base_forms(relation, t)) > 0, "D_affixal")
    )


def existing_cues(relation: Antonyms, tok: Column, text: Column) -> Column:
    """(token_idx, cue_text, family) of the cues in order; a two-word quantifier is one cue."""
    pairs = [F.array(F.lit(a), F.lit(b)) for a, b in lexicons.QUANTIFIER_BIGRAMS]
    opens = lambda i: F.array_contains(F.array(*pairs), F.array(token(tok, i)["lower"], F.coalesce(token(tok, i + 1)["lower"], F.lit(""))))
    made = lambda i, words, family: F.struct(i.alias("token_idx"), words.alias("cue_text"), family.alias("family"))

    def cue(t: Column) -> Column:
        after = token(tok, t["i"] + 1)
        both = F.substr(text, t["idx"] + 1, ends_at(after) - t["idx"])
        inside = (t["i"] > 0) & F.coalesce(opens(F.greatest(t["i"] - 1, F.lit(0))), F.lit(False))
        family = cue_family(relation, tok, t)
        return F.when(opens(t["i"]), made(t["i"], both, F.lit("B_quantifier"))).when(~inside & family.isNotNull(), made(t["i"], t["text"], family))

    return F.array_compact(F.transform(tok, cue))


# classification


def is_inverted(tok: Column, verb: Column) -> Column:
    """Whether the finite auxiliary of a verb, or the verb as one, stands before its subject."""
    at = subject(tok, verb)
    fronted = F.exists(tok, lambda c: (c["head"] == verb) & (c["i"] != verb) & c["dep"].isin(AUXILIARY) & (c["i"] < at))
    return F.coalesce(((token(tok, verb)["pos"] == "AUX") & (verb < at)) | fronted, F.lit(False))


def clause_type(tok: Column, text: Column) -> Column:
    top, opener, held = token(tok, root(tok)), F.get(tok, 0), F.trim(text)
    inverted, wh = is_inverted(tok, root(tok)), F.coalesce(opener["tag"].isin("WP", "WDT", "WRB", "WP$"), F.lit(False))
    command = F.coalesce((top["tag"] == "VB") & subject(tok, root(tok)).isNull(), F.lit(False))
    return (
        F.when(F.endswith(held, F.lit("?")) | (inverted & wh), "interrogative")
        .when(command, "imperative")
        .when(F.endswith(held, F.lit("!")) | (wh & opener["lower"].isin("what", "how") & ~inverted), "exclamative")
        .when(inverted, "interrogative")
        .otherwise("declarative")
    )


def voice(tok: Column) -> Column:
    return F.when(F.exists(tok, lambda t: t["dep"].isin("auxpass", "nsubjpass", "csubjpass")), "passive").otherwise("active")


def root_modal(tok: Column, modals: list[str]) -> Column:
    """The first of the modals at the root of the sentence, as a token."""
    at = root(tok)
    return F.get(F.filter(tok, lambda t: ((t["head"] == at) | (t["i"] == at)) & (t["tag"] == "MD") & among(t["lower"], modals)), 0)


def modality(tok: Column) -> Column:
    return F.coalesce(looked_up(lexicons.MODALITY, root_modal(tok, list(lexicons.MODALITY))["lower"]), F.lit("none"))


def copula_type(tok: Column) -> Column:
    at = root(tok)
    has = lambda deps: F.exists(tok, lambda c: (c["head"] == at) & (c["i"] != at) & c["dep"].isin(deps))
    top = token(tok, at)
    be = (top["lemma"] == "be") & is_verbal(top) & (has(PREDICATIVE) | ~has(AUXILIARY))
    return F.when(be, "be").when(top["lemma"].isin(SEEMING) & has(PREDICATIVE), "become/seem/appear").when(has(["cop"]), "be").otherwise("none")


def is_existential(tok: Column) -> Column:
    return F.exists(tok, lambda t: (t["dep"] == "expl") & (t["lower"] == "there"))


def is_comparative(tok: Column) -> Column:
    return F.exists(tok, lambda t: t["tag"].isin("JJR", "RBR") | ((t["lower"] == "than") & t["dep"].isin("prep", "mark", "pcomp")))


def is_conditional(tok: Column) -> Column:
    return F.exists(tok, lambda t: t["lower"].isin("if", "unless") & (t["dep"] == "mark"))


def has_subordinate(tok: Column) -> Column:
    return F.exists(tok, lambda t: t["dep"].isin(SUBORDINATE))


def profile(relation: Antonyms, tok: Column, text: Column) -> Column:
    """Everything that rules ask of a sentence, as one struct."""
    cues = existing_cues(relation, tok, text)
    return F.struct(
        clause_type(tok, text).alias("clause_type"),
        voice(tok).alias("voice"),
        F.when(F.size(cues) > 0, "negated").otherwise("affirmative").alias("polarity"),
        cues.alias("existing_cues"),
        F.size(cues).alias("existing_count"),
        modality(tok).alias("modality"),
        F.size(clause_heads(tok)).alias("clause_count"),
        has_subordinate(tok).alias("has_subordinate"),
        is_existential(tok).alias("is_existential"),
        is_comparative(tok).alias("is_comparative"),
        is_conditional(tok).alias("is_conditional"),
        copula_type(tok).alias("copula_type"),
    )


# clause frames


def do_form(t: Column) -> Column:
    """The form of do that takes over a verb's tense, person and number; null if it has none to give."""
    third = (t["tag"] == "VBZ") | ((t["person"] == "3") & (t["number"] == "Sing"))
    present = (t["tense"] == "Pres") | t["tag"].isin("VBZ", "VBP")
    return F.when(t["tense"] == "Past", "did").when(present, F.when(third, "does").otherwise("do")).when(t["tag"] == "VBD", "did").when(t["tag"] == "VB", "do")


def inherited_subject(tok: Column, i: Column) -> Column:
    """A verb's subject, or that of the verb it is joined to."""
    has = lambda t: F.exists(tok, lambda c: (c["head"] == t["i"]) & (c["i"] != t["i"]) & c["dep"].isin(SUBJECTS))
    return subject(tok, F.get(nearest(tok, lambda t: has(t) | (t["dep"] != "conj")), i))


def insertion_point(tok: Column, i: Column, owner: Column) -> Column:
    """Offset where a do before a verb belongs: left of adverbs between subject and verb."""
    start = lambda c: token(tok, F.array_min(subtree(tok, c["i"])))["idx"]
    adverbs = children(tok, i, lambda c: (c["i"] < i) & c["dep"].isin(PREVERBAL))
    after = F.filter(F.transform(adverbs, start), lambda at: owner.isNull() | (at > token(tok, owner)["idx"]))
    return F.least(token(tok, i)["idx"], F.array_min(after))


def frame(tok: Column, i: Column) -> Column:
    """(head, subtype, aux, do_form, subject, imperative, slot, at) of a clause head; null if it takes no negator.

    subtype is existing_aux, copula or do_support; slot is the place of the finite word, at the offset for do.
    """
    t, aux, owner = token(tok, i), finite_aux(tok, i), inherited_subject(tok, i)
    imperative = owner.isNull() & (t["tag"] == "VB")
    support = do_form(t).isNotNull() & (owner.isNotNull() | imperative)
    subtype = F.when(aux.isNotNull(), "existing_aux").when(t["lemma"] == "be", "copula").when(support, "do_support")
    made = F.struct(
        t["i"].alias("head"),
        subtype.alias("subtype"),
        aux.alias("aux"),
        F.when(subtype == "do_support", do_form(t)).alias("do_form"),
        owner.alias("subject"),
        F.coalesce((subtype == "do_support") & imperative, F.lit(False)).alias("imperative"),
        F.coalesce(aux, t["i"]).alias("slot"),
        insertion_point(tok, i, owner).alias("at"),
    )
    return F.when(is_verbal(t) & subtype.isNotNull(), made)


def frames(tok: Column, heads: Column) -> Column:
    """The frames of several heads, without those that have none."""
    return F.array_compact(F.transform(heads, lambda i: frame(tok, i)))


def be_form(tok: Column, held: Column) -> Column:
    """The form of be that agrees with a frame's subject and tense."""
    head, owner = token(tok, held["head"]), token(tok, held["subject"])
    word = F.coalesce(owner["lower"], F.lit(""))
    you = word.isin("you", "we", "they")
    plural = F.coalesce((owner["number"] == "Plur") | owner["tag"].isin("NNS", "NNPS"), F.lit(False)) | you
    person = F.when(word == "i", "1").when(you, "2").otherwise(F.coalesce(owner["person"], F.lit("3")))
    past = F.coalesce(head["tense"] == "Past", F.lit(False)) | (head["tag"] == "VBD")
    return F.when(past, F.when(plural | (person == "2"), "were").otherwise("was")).when(plural | (person == "2"), "are").when(person == "1", "am").otherwise("is")


def agreeing(lemma: Column, tok: Column, held: Column) -> Column:
    """A lemma with the tense and agreement of a frame's verb."""
    head = token(tok, held["head"])
    support = held["subtype"] == "do_support"
    past = F.when(support, held["do_form"] == "did").otherwise(F.coalesce(head["tense"] == "Past", F.lit(False)) | (head["tag"] == "VBD"))
    third = F.when(support, held["do_form"] == "does").otherwise(head["tag"] == "VBZ")
    return F.when(lemma == "be", be_form(tok, held)).when(past, morphology.past(lemma)).when(third, morphology.third_person(lemma)).otherwise(lemma)


# parts of a sentence that rules look for


def quantified_subject(tok: Column) -> Column:
    """Place of the root's subject if a quantifier with two scope readings stands in it."""
    at = subject(tok, root(tok))
    by_det = F.exists(tok, lambda c: (c["head"] == at) & c["dep"].isin("det", "predet") & among(c["lower"], lexicons.SCOPE_BEARING))
    return F.when(among(token(tok, at)["lower"], lexicons.SCOPE_BEARING) | by_det, at)


def is_quantifier(t: Column) -> Column:
    return among(t["lower"], list(lexicons.QUANTIFIER_SWAPS)) & among(t["dep"], QUANTIFIER_ROLES)


def possession_object(tok: Column) -> Column:
    """Place of what the root says that its subject has."""
    return F.when(token(tok, root(tok))["lemma"].isin(lexicons.POSSESSION_VERBS), first_child(tok, root(tok), lambda c: c["dep"].isin("dobj", "attr")))


def has_object(tok: Column, i: Column) -> Column:
    return F.size(children(tok, i, lambda c: c["dep"].isin("dobj", "dative", "attr", "oprd"))) > 0


def copular_complement(tok: Column) -> Column:
    return first_child(tok, root(tok), lambda c: c["dep"].isin("acomp", "attr"))


def fronted_aux(tok: Column) -> Column:
    """Place of the auxiliary before the root's subject; the root itself if it is one."""
    at, owner = root(tok), subject(tok, root(tok))
    moved = first_child(tok, at, lambda c: c["dep"].isin(AUXILIARY) & (c["i"] < owner))
    return F.when((token(tok, at)["pos"] == "AUX") & (at < owner), at).otherwise(moved)


def subject_end(tok: Column, owner: Column) -> Column:
    """Offset behind a subject, without predicates that hang on it by mistake."""
    astray = nearest(tok, lambda t: (t["i"] == owner) | ((t["head"] == owner) & (t["i"] > owner) & t["dep"].isin("amod", *PREDICATIVE)))
    kept = F.filter(_led_to(astray, owner), lambda k: ~token(tok, k)["is_punct"])
    return ends_at(token(tok, F.array_max(kept)))


def existential_complement(tok: Column) -> Column:
    at = root(tok)
    there = F.exists(tok, lambda c: (c["head"] == at) & (c["dep"] == "expl") & (c["lower"] == "there"))
    return F.when(there, first_child(tok, at, lambda c: c["dep"].isin("attr", "nsubj", "dobj")))


def comparative_head(tok: Column) -> Column:
    """Place of the comparative that a than follows, on itself or on the word that it modifies."""
    than = lambda i: F.exists(tok, lambda c: (c["head"] == i) & (c["lower"] == "than"))
    return F.get(places(tok, lambda t: t["tag"].isin("JJR", "RBR") & (than(t["i"]) | ((t["dep"] == "advmod") & than(t["head"])))), 0)


def preposed_negator(tok: Column, owner: Column) -> Column:
    """Place of a negator inside a subject and before its head."""
    held = subtree(tok, owner)
    return F.get(places(tok, lambda t: (t["dep"] == "neg") & (t["i"] < owner) & F.array_contains(held, t["i"])), 0)


def infinitive_below(tok: Column, i: Column) -> Column:
    """Place of the verb that a trigger embeds with to."""
    to = lambda v: F.exists(tok, lambda c: (c["head"] == v["i"]) & (c["lower"] == "to") & (c["dep"] == "aux"))
    return first_child(tok, i, lambda c: c["dep"].isin("xcomp", "ccomp") & (c["pos"] == "VERB") & to(c))


def gerund_below(tok: Column, i: Column) -> Column:
    return first_child(tok, i, lambda c: c["dep"].isin("xcomp", "ccomp") & (c["tag"] == "VBG"))


def finite_be(tok: Column, i: Column) -> Column:
    """Place of the be that a predicate hangs on, as its head or an auxiliary of that."""
    head = token(tok, token(tok, i)["head"])
    return F.when(is_verbal(head) & (head["lemma"] == "be"), head["i"]).otherwise(first_child(tok, head["i"], lambda c: c["dep"].isin(AUXILIARY) & (c["lemma"] == "be")))


def span_without_punct(tok: Column, held: Column) -> Column:
    """(start, end) offsets of places in order, without punctuation at their end."""
    last = F.array_max(F.filter(held, lambda k: ~token(tok, k)["is_punct"]))
    return F.when(
        last.isNotNull(), F.struct(token(tok, F.array_min(held))["idx"].alias("start"), ends_at(token(tok, last)).alias("end"))
    ).otherwise(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))
