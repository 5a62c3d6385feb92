"""English inflection as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions import lexicons
from tessera.functions.tables import looked_up


def _lookup(lemma: Column, place: int, otherwise: Column) -> Column:
    return F.coalesce(looked_up({row[0]: row[place] for row in lexicons.IRREGULAR_VERBS}, lemma), otherwise)


def third_person(lemma: Column) -> Column:
    """-s, -es or -ies."""
    return (
        F.when(lemma == "be", "is")
        .when(lemma == "have", "has")
        .when(lemma.rlike("[^aeiou]y$"), F.regexp_replace(lemma, "y$", "ies"))
        .when(lemma.rlike("(?:s|x|z|ch|sh|o)$"), F.concat(lemma, F.lit("es")))
        .otherwise(F.concat(lemma, F.lit("s")))
    )


def doubles(lemma: Column) -> Column:
    """Whether a short consonant-vowel-consonant ending doubles."""
    return lemma.rlike("[^aeiou][aeiou][^aeiouwxy]$")


def _regular_past(lemma: Column) -> Column:
    return (
        F.when(lemma.rlike("e$"), F.concat(lemma, F.lit("d")))
        .when(lemma.rlike("[^aeiou]y$"), F.regexp_replace(lemma, "y$", "ied"))
        .when(doubles(lemma), F.concat(lemma, F.substr(lemma, F.length(lemma)), F.lit("ed")))
        .otherwise(F.concat(lemma, F.lit("ed")))
    )


def past(lemma: Column) -> Column:
    return _lookup(lemma, 1, _regular_past(lemma))


def past_participle(lemma: Column) -> Column:
    return _lookup(lemma, 2, _regular_past(lemma))


def present_participle(lemma: Column) -> Column:
    return (
        F.when(lemma.rlike("ie$"), F.regexp_replace(lemma, "ie$", "ying"))
        .when(lemma.rlike("^e$|[^eoy]e$"), F.regexp_replace(lemma, "e$", "ing"))
        .when(doubles(lemma), F.concat(lemma, F.substr(lemma, F.length(lemma)), F.lit("ing")))
        .otherwise(F.concat(lemma, F.lit("ing")))
    )


def inflect(lemma: Column, tag: Column) -> Column:
    """The form of a Penn tag."""
    return (
        F.when(tag == "VBZ", third_person(lemma))
        .when(tag == "VBD", past(lemma))
        .when(tag == "VBN", past_participle(lemma))
        .when(tag == "VBG", present_participle(lemma))
        .otherwise(lemma)
    )


def contracted(aux: Column) -> Column:
    """The negative contraction of an auxiliary, in its case; null where there is none."""
    low = F.lower(aux)
    made = F.coalesce(looked_up(lexicons.CONTRACTIONS, low), F.concat(low, F.lit("n't")))
    capital = F.substr(aux, F.lit(1), F.lit(1)) != F.substr(low, F.lit(1), F.lit(1))
    cased = F.when(capital, F.concat(F.upper(F.substr(made, F.lit(1), F.lit(1))), F.substr(made, F.lit(2)))).otherwise(made)
    return F.when(~low.isin(lexicons.UNCONTRACTABLE), cased)


def negative_derivations(stem: Column) -> Column:
    """Candidate negative derivations: prefixes whose onsets fit, and -less for -ful."""
    options = []
    for p in lexicons.NEGATIVE_PREFIXES:
        onset = lexicons.PREFIX_ONSETS.get(p)
        made = F.concat(F.lit(p), stem)
        options.append(F.when(stem.rlike(f"^[{onset}]"), made) if onset else made)
    options.append(F.when(stem.rlike("ful$"), F.regexp_replace(stem, "ful$", "less")))
    return F.array_compact(F.array(*options))
