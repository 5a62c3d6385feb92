"""Cues as corpora annotate them, mapped to families; offsets of their tokens; sentences of definitions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions import lexicons, parsed as P, text as X
from tessera.functions.tables import among, looked_up, rows

UNMAPPED = "unmapped"
# Spellings of clausal negators, and endings of implicit triggers.
SYNTACTIC = [
    "not", "n't", "nt", "cannot", "cant", "dont", "doesnt", "didnt", "isnt", "wasnt", "arent", "werent", "wont", "couldnt", "wouldnt", "shouldnt", "havent",
    "hasnt", "hadnt", *lexicons.NEGATIVE_AUX_BASES,
]
TRIGGER_ENDINGS = ["s", "d", "ed", "es", "ing", "ure"]
PHRASES = {m[0]: "I_intensified" for m in lexicons.INTENSIFIERS if " " in m[0]} | {p: "J_contrastive" for p, _ in lexicons.CONTRASTIVE_FRAMES}


def normalised(cue: Column) -> Column:
    """Lower case, straight apostrophes in every spelling, single blanks."""
    return F.trim(F.regexp_replace(F.translate(F.lower(cue), "’‘´`\u0092", "'''''"), r"\s+", " "))


def is_affix(cue: Column, word: Column) -> Column:
    """Whether a cue is a negative affix of its token and not the token itself."""
    c, w = normalised(cue), normalised(word)
    edge = F.startswith(w, c) | F.endswith(w, c)
    return F.coalesce((c != "") & (F.length(c) < F.length(w)) & edge & among(c, [*lexicons.NEGATIVE_PREFIXES, "less"]), F.lit(False))


def is_implicit(word: Column) -> Column:
    """Whether a word is an implicit trigger in any inflection."""
    forms = [*P.TRIGGER_LEMMAS, *P.TRIGGER_PREDICATES, *[x + e for x in P.TRIGGER_LEMMAS for e in TRIGGER_ENDINGS]]
    return among(word, forms)


def looks_affixed(word: Column) -> Column:
    """Whether a word that is known to be negative is so by its shape."""
    prefixed = F.exists(rows("p", [(p,) for p in lexicons.NEGATIVE_PREFIXES]), lambda x: F.startswith(word, x["p"]) & (F.length(word) - F.length(x["p"]) >= 3))
    return (F.endswith(word, F.lit("less")) & (F.length(word) > 6)) | prefixed


def family(cue: Column, word: Column, annotation: Column) -> Column:
    """The family of an annotated cue: of its phrase, else by the first list that holds one of its words, else unmapped."""
    surface = normalised(cue)
    words = F.split(surface, " ")
    has = lambda held: F.exists(words, lambda w: among(w, held))
    return (
        F.when(surface == "", UNMAPPED)
        .when(annotation == "speculation", "H_hedged")
        .when(is_affix(cue, word), "D_affixal")
        .when(among(surface, PHRASES), looked_up(PHRASES, surface))
        .when(surface.isin("no one", "no-one"), "B_quantifier")
        .when(has(lexicons.NEGATIVE_ADVERBS), "C_neg_adverb")
        .when(has(lexicons.NEGATIVE_QUANTIFIERS), "B_quantifier")
        .when(has(SYNTACTIC), "A_syntactic")
        .when(has(lexicons.PRIVATIVE_HEADS), "G_prepositional")
        .when(F.exists(words, is_implicit), "F_implicit")
        .when((F.size(words) == 1) & among(surface, lexicons.LEXICALLY_NEGATIVE), F.when(looks_affixed(surface), "D_affixal").otherwise("F_implicit"))
        .otherwise(UNMAPPED)
    )


def scope_position(label: Column, tokens: Column, cue_idx: Column) -> Column:
    """The family, or that of scope if a quantifier follows a syntactic cue."""
    after = F.lower(F.get(tokens, F.array_max(cue_idx) + 1))
    return F.when((label == "A_syntactic") & F.coalesce(among(after, lexicons.SCOPE_BEARING), F.lit(False)), "L_scope_position").otherwise(label)


def char_offsets(tokens: Column) -> Column:
    """Offsets of tokens in their text joined by blanks."""
    return F.transform(tokens, lambda t, i: F.aggregate(F.slice(tokens, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x) + 1))


def aligned(tokens: Column, tok: Column) -> Column:
    """For each token the place of the parser's token that holds its first character; null if none does."""
    return F.transform(char_offsets(tokens), lambda at: F.get(P.places(tok, lambda t: (t["idx"] <= at) & (at < P.ends_at(t))), 0))


# definitions: (In ..., )subject is|are|... the rest

COPULA = r"^((?:In [^,]{1,60}, )?)(.+?) (is|are|refers to|describes|denotes) (.+)$"
TAIL = r"(,| that | which | who | where | in which | used | using | for | by | to | with | when | whose )"


def split_definition(definition: Column) -> Column:
    """(lead, subj, cop, rest) of a definition; null where it has another form."""
    part = lambda k: F.regexp_extract(definition, COPULA, k)
    made = F.struct(part(1).alias("lead"), part(2).alias("subj"), part(3).alias("cop"), F.rtrim(part(4), F.lit(".")).alias("rest"))
    return F.when(definition.rlike(COPULA), made)


def capital(text: Column) -> Column:
    return F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.substr(text, F.lit(2)))


def lower_first(text: Column) -> Column:
    """The text with a small first letter if its first word is an article or a plain word: letters small from the second on."""
    word = F.get(F.split(text, " "), 0)
    plain = word.isin("A", "An", "The") | (word.rlike(r"^\p{Lu}\p{Ll}+$") & ~F.lower(word).isin("unix", "linux", "windows"))
    return F.when(plain, F.concat(F.lower(F.substr(text, F.lit(1), F.lit(1))), F.substr(text, F.lit(2)))).otherwise(text)


def paraphrase(definition: Column, pick: Column) -> Column:
    """A definition in another form; pick (0 or more) chooses among four for `is`, other verbs have one."""
    d = split_definition(definition)
    subj = lower_first(d["subj"])
    dot = F.lit(".")
    simply = F.concat(F.lit("Put simply, "), subj, F.lit(" "), d["cop"], F.lit(" "), d["rest"], dot)
    forms = F.array(
        F.concat(d["subj"], F.lit(" can be described as "), d["rest"], dot),
        F.concat(F.lit("The term "), subj, F.lit(" refers to "), d["rest"], dot),
        simply,
        F.concat(capital(d["rest"]), F.lit(": that is what "), subj, F.lit(" means.")),
    )
    return F.when(d["cop"] == "is", F.get(forms, F.pmod(pick, F.lit(4)).cast("int"))).otherwise(simply)


def partial(definition: Column) -> Column:
    """A definition cut before the first word that adds to it; null if that leaves fewer than two words."""
    d = split_definition(definition)
    at = F.regexp_instr(d["rest"], F.lit(TAIL))
    short = F.trim(F.substr(d["rest"], F.lit(1), at - 1))
    fits = (at > 3) & (F.size(F.split(short, r"\s+")) >= 2) & (short != d["rest"])
    return F.when(fits, F.concat(d["subj"], F.lit(" "), d["cop"], F.lit(" "), short, F.lit(".")))


def lead_sentence(raw: Column) -> Column:
    """The first sentence of an encyclopaedia's text, without brackets and notes."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"\s*\([^()]*\)", ""), r"\[[^\]]*\]", "")
    return F.trim(F.regexp_replace(F.regexp_extract(X.spacing(bare), r"^(.*?[.!?])(?:\s+\p{Lu}|\s*$)", 1), r"\s+", " "))
