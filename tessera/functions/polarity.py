"""Polarity of parsed sentences: cues with their clause and intensity, and five scores of how negated a sentence is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from tessera.functions import lexicons, parsed as P, text as X
from tessera.functions.tables import among, looked_up, rows

HEDGE_WORDS = [h[0] for h in lexicons.HEDGES]
INTENSIFIER_WORDS = [m[0] for m in lexicons.INTENSIFIERS if " " not in m[0]]
PARTIAL_ADVERBS = [w for w, (kind, _) in lexicons.NEGATIVE_ADVERBS.items() if kind == "partial"]


def analysis(relation: P.Antonyms, tok: Column, text: Column) -> Column:
    """(text, family, clause, main_clause, hedged, intensified) of every cue: those of cue families, then contrastive phrases.

    clause is the place of the clause's head. A cue is hedged or intensified by a word of its clause; by no means and not
    at all are intensified by themselves.
    """
    clause = P.clause_of(tok)
    own = F.transform(P.existing_cues(relation, tok, text), lambda c: F.struct(c["token_idx"].alias("i"), F.lower(c["cue_text"]).alias("text"), c["family"].alias("family")))

    def phrase(x: Column) -> Column:
        at = F.call_function("locate", x["words"], F.lower(text))
        first = F.get(P.places(tok, lambda t: P.ends_at(t) >= at), 0)
        return F.when(at > 0, F.struct(first.alias("i"), x["words"].alias("text"), F.lit("J_contrastive").alias("family")))

    contrastive = F.array_compact(F.transform(rows("words subtype", lexicons.CONTRASTIVE_FRAMES), phrase))
    word = lambda i: F.coalesce(P.token(tok, i)["lower"], F.lit(""))

    def made(c: Column) -> Column:
        head = F.get(clause, c["i"])
        in_clause = lambda words: F.exists(tok, lambda t: (F.get(clause, t["i"]) == head) & among(t["lower"], words))
        before = F.when(c["i"] > 0, word(F.greatest(c["i"] - 1, F.lit(0)))).otherwise("")
        by_no_means = (c["text"] == "no") & (before == "by") & (word(c["i"] + 1) == "means")
        not_at_all = c["text"].isin("not", "n't") & (word(c["i"] + 1) == "at") & (word(c["i"] + 2) == "all")
        return F.struct(
            c["text"].alias("text"),
            c["family"].alias("family"),
            head.alias("clause"),
            (P.token(tok, head)["dep"] == "ROOT").alias("main_clause"),
            in_clause(HEDGE_WORDS).alias("hedged"),
            (in_clause(INTENSIFIER_WORDS) | by_no_means | not_at_all).alias("intensified"),
        )

    return F.transform(F.concat(own, contrastive), made)


def intensity(cue: Column) -> Column:
    return F.when(among(cue["text"], PARTIAL_ADVERBS), "partial").when(cue["intensified"], "intensified").when(cue["hedged"], "hedged").otherwise("neutral")


def _weight(table: dict[str, float], key: Column) -> Column:
    return looked_up({k: str(v) for k, v in table.items()}, key).cast("double")


def cue_weight(cue: Column, families: dict[str, float] | None = None, intensities: dict[str, float] | None = None) -> Column:
    """Weight of a cue's family times that of its intensity."""
    return _weight(families or lexicons.FAMILY_WEIGHT, cue["family"]) * _weight(intensities or lexicons.INTENSITY_WEIGHT, intensity(cue))


def _by_clause(cues: Column, score: Callable[[Column], Column]) -> Column:
    """The greatest of the clauses' scores; 0 without cues. `score` takes the cues of a clause."""
    clauses = F.array_distinct(F.transform(cues, lambda c: c["clause"]))
    return F.coalesce(F.array_max(F.transform(clauses, lambda k: score(F.filter(cues, lambda c: c["clause"] == k)))), F.lit(0.0))


def any_cue(cues: Column) -> Column:
    """v1: 1 with a cue."""
    return F.when(F.size(cues) > 0, 1.0).otherwise(0.0)


def parity(cues: Column) -> Column:
    """v2: 1 if some clause has an odd number of cues."""
    return _by_clause(cues, lambda held: (F.size(held) % 2).cast("double"))


def graded(cues: Column, intensities: dict[str, float] | None = None) -> Column:
    """v3: soft exclusive-or of intensity weights, of the most negated clause."""
    return _by_clause(cues, lambda held: X.soft_xor(F.transform(held, lambda c: _weight(intensities or lexicons.INTENSITY_WEIGHT, intensity(c)))))


def weighted(cues: Column, families: dict[str, float] | None = None, intensities: dict[str, float] | None = None) -> Column:
    """v4: soft exclusive-or of family times intensity weights."""
    return _by_clause(cues, lambda held: X.soft_xor(F.transform(held, lambda c: cue_weight(c, families, intensities))))


def strongest(cues: Column, families: dict[str, float] | None = None, intensities: dict[str, float] | None = None) -> Column:
    """v5: an even number of cues in a clause cancels, an odd one leaves the weight of the strongest."""
    return _by_clause(cues, lambda held: F.when(F.size(held) % 2 == 1, F.array_max(F.transform(held, lambda c: cue_weight(c, families, intensities)))).otherwise(0.0))


VERSIONS = {"v1": any_cue, "v2": parity, "v3": graded, "v4": weighted, "v5": strongest}


def pair_score(name: str, p_a: Column, p_b: Column, cos: Column, c_resid: Column, gate: float | None = None) -> Column:
    """f1 to f5: the difference of polarities by itself, times a similarity, or behind a gate on it."""
    delta = p_b - p_a
    forms = {
        "f1": F.abs(delta) * cos,
        "f2": F.abs(delta) * c_resid,
        "f3": F.abs(delta),
        "f4": F.when(cos >= F.lit(gate), F.abs(delta)).otherwise(0.0),
        "f5": delta,
    }
    return forms[name]


def self_cancels(cues: Column) -> Column:
    """Whether some clause has two cues or another even number."""
    return _by_clause(cues, lambda held: F.when((F.size(held) >= 2) & (F.size(held) % 2 == 0), 1.0).otherwise(0.0)) == 1


def cancellation_detected(a: Column, b: Column) -> Column:
    """b's cues cancel within a clause, and both sentences have the same parity."""
    return self_cancels(b) & (parity(a) == parity(b))


def differing_cues(a: Column, b: Column) -> Column:
    """Cues of b that a has fewer of, by text and family; if there are none, those of a that b has fewer of."""
    same = lambda held, c: F.size(F.filter(held, lambda o: (o["text"] == c["text"]) & (o["family"] == c["family"])))
    more = F.filter(b, lambda c: same(b, c) > same(a, c))
    return F.when(F.size(more) > 0, more).otherwise(F.filter(a, lambda c: same(a, c) > same(b, c)))


# Families of scope and lexical changes, and words that hedge a whole sentence.
SCOPE_FAMILIES = ["B_quantifier", "L_scope_position"]
LEXICAL_FAMILIES = ["D_affixal", "E_antonym", "F_implicit"]
HEDGING = ["might", "may", "maybe", "perhaps", "probably", "possibly", "think", "believe", "could", "likely", "seem", "seems"]


def severity(a: Column, b: Column, b_text: Column) -> Column:
    """scope, intensified, hedged, flat or lexical: what the cues that differ change, the gravest first."""
    cues = differing_cues(a, b)
    words = F.split(F.replace(F.lower(b_text), F.lit("n't"), F.lit(" not")), r"\s+")
    has = lambda held: F.exists(words, lambda w: among(w, held))
    hedged = F.exists(cues, lambda c: c["hedged"] | c["family"].isin("H_hedged", "M_modal")) | ((F.size(cues) > 0) & has(HEDGING) & has(["not", "no", "never"]))
    return (
        F.when(F.exists(cues, lambda c: c["family"].isin(SCOPE_FAMILIES) & ~c["intensified"]), "scope")
        .when(F.exists(cues, lambda c: c["intensified"] | (c["family"] == "I_intensified")), "intensified")
        .when(hedged, "hedged")
        .when(F.exists(cues, lambda c: ~c["family"].isin(LEXICAL_FAMILIES)), "flat")
        .otherwise("lexical")
    )


# conditionals


def conditionals(tok: Column) -> Column:
    """(marker, ante_heads, ante_span, cons_heads, cons_span, nested) of every conditional, in order.

    Heads are a clause's head and the verbs, adjectives and nouns joined to it; spans are their clauses' places without
    punctuation. nested: its consequent stands inside another one's antecedent.
    """
    joined = P.nearest(tok, lambda t: ~((t["dep"] == "conj") & t["pos"].isin("VERB", "AUX", "ADJ", "NOUN")))
    with_conj = lambda i: F.array_distinct(F.concat(F.array(i), P.places(tok, lambda t: (F.get(joined, t["i"]) == i) & (t["i"] != i))))

    def span(heads: Column) -> Column:
        inside = F.flatten(F.transform(heads, lambda h: P.clause_scope(tok, h)))
        return P.places(tok, lambda t: F.array_contains(inside, t["i"]) & ~t["is_punct"])

    def mark(t: Column) -> Column:
        kids = P.children(tok, t["i"], lambda c: c["dep"].isin("mark", "advmod"))
        has = lambda w: F.exists(kids, lambda c: c["lower"] == w)
        place = F.get(F.filter(kids, lambda c: c["lower"] == "if"), 0)["i"]
        before = F.when(place > 0, P.token(tok, F.greatest(place - 1, F.lit(0)))["lower"]).otherwise("")
        plain = F.when(before == "as", None).when(before.isin("even", "only"), F.concat(before, F.lit(" if"))).otherwise("if")
        adverbial = F.when(has("if"), plain).when(has("unless"), "unless").when(has("whenever"), "whenever").when(has("when"), "when")
        return F.when(t["dep"] == "advcl", adverbial)

    def found(t: Column) -> Column:
        comp = P.first_child(tok, t["i"], lambda c: c["dep"] == "ccomp")
        headed = F.when(t["lower"].isin("provided", "assuming") & t["dep"].isin("advcl", "prep") & comp.isNotNull(), t["lower"])
        marker = F.coalesce(mark(t), headed)
        ante = F.when(mark(t).isNotNull(), t["i"]).otherwise(comp)
        return F.when(marker.isNotNull(), F.struct(marker.alias("marker"), ante.alias("ante"), t["head"].alias("cons")))

    raw = F.array_compact(F.transform(tok, found))
    return F.transform(
        raw,
        lambda c: F.struct(
            c["marker"].alias("marker"),
            with_conj(c["ante"]).alias("ante_heads"),
            span(with_conj(c["ante"])).alias("ante_span"),
            with_conj(c["cons"]).alias("cons_heads"),
            span(with_conj(c["cons"])).alias("cons_span"),
            F.exists(raw, lambda o: (o["ante"] != c["ante"]) & F.array_contains(P.subtree(tok, o["ante"]), c["cons"])).alias("nested"),
        ),
    )


def primary_conditional(found: Column) -> Column:
    """The outermost conditional, the leftmost of several; null without one."""
    outer = F.filter(found, lambda c: ~c["nested"])
    held = F.when(F.size(outer) > 0, outer).otherwise(found)
    return F.get(F.array_sort(held, lambda x, y: F.get(x["ante_heads"], 0) - F.get(y["ante_heads"], 0)), 0)


def half_polarity(cues: Column, heads: Column, negated: Column) -> Column:
    """Parity of the cues in the clauses of the heads, one more if the half starts negated."""
    return (F.size(F.filter(cues, lambda c: F.array_contains(heads, c["clause"]))) + negated.cast("int")) % 2


def conditional_decision(cond_a: Column, cond_b: Column, cues_a: Column, cues_b: Column) -> Column:
    """negation, contraposition, not_negation or null, by which halves of two conditionals differ in parity."""
    ante = lambda c, cues: half_polarity(cues, c["ante_heads"], c["marker"] == "unless")
    cons = lambda c, cues: half_polarity(cues, c["cons_heads"], F.lit(False))
    other = (cond_a["marker"] != cond_b["marker"]) & (cond_a["marker"].isin("even if", "only if") | cond_b["marker"].isin("even if", "only if"))
    first, second = ante(cond_a, cues_a) != ante(cond_b, cues_b), cons(cond_a, cues_a) != cons(cond_b, cues_b)
    decided = F.when(first & second, "contraposition").when(second, "negation").when(first, "not_negation")
    return F.when(cond_a.isNotNull() & cond_b.isNotNull() & ~other, decided)
