"""Pairs of parsed sentences by what differs between them: aligned blocks, antonyms, rules on both.

Alignment is Ratcliff and Obershelp's, which no column expression gives: it runs on Arrow batches, a pair at a time.
"""

from __future__ import annotations

import difflib
import re

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from tessera.functions import lexicons, parsed as P, text as X
from tessera.functions.tables import among

# Words that alignment rules look through.
NEGATORS = ["not", "n't", "no", "never", "cannot", "nor", "neither", "none", "nobody", "nothing"]
DETERMINERS = ["a", "an", "the"]
BLOCK = StructType([StructField("tag", StringType()), *[StructField(n, IntegerType()) for n in ("a_from", "a_to", "b_from", "b_to")]])


@F.arrow_udf(ArrayType(BLOCK))
def _blocks(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        codes = difflib.SequenceMatcher(a=x or [], b=y or [], autojunk=False).get_opcodes()
        out.append([dict(zip(("tag", "a_from", "a_to", "b_from", "b_to"), c)) for c in codes if c[0] != "equal"])
    return pa.array(out, pa.list_(pa.struct([("tag", pa.string()), *[(n, pa.int32()) for n in ("a_from", "a_to", "b_from", "b_to")]])))


def words_only(tok: Column) -> Column:
    """The tokens without punctuation."""
    return F.filter(tok, lambda t: t["pos"] != "PUNCT")


def diff(a: Column, b: Column) -> Column:
    """(tag, a, b) of the blocks in which two token arrays differ by lemma, with their tokens; punctuation doesn't count."""
    x, y = words_only(a), words_only(b)
    found = _blocks(F.transform(x, lambda t: t["lemma"]), F.transform(y, lambda t: t["lemma"]))
    part = lambda held, lo, hi: F.slice(held, lo + 1, hi - lo)
    return F.transform(found, lambda c: F.struct(c["tag"].alias("tag"), part(x, c["a_from"], c["a_to"]).alias("a"), part(y, c["b_from"], c["b_to"]).alias("b")))


def are_antonyms(relation: P.Antonyms, x: Column, y: Column) -> Column:
    """Whether two tokens are antonyms by word or lemma, either way; equal words never are."""
    curated = [row for a, b in lexicons.CURATED_ANTONYMS for row in ((a, "*", b), (b, "*", a))]
    every = [(a, "*", b) for a, _, b in relation] + [(b, "*", a) for a, _, b in relation] + curated
    forms = lambda t: F.array(t["lower"], F.lower(t["lemma"]))
    linked = F.exists(forms(x), lambda w: F.arrays_overlap(P.antonyms_of(every, w, F.lit("*")), forms(y)))
    return linked & ~F.arrays_overlap(forms(x), forms(y))


def antonym_aligned(relation: P.Antonyms, found: Column) -> Column:
    """Whether the blocks of diff() are one swap of antonyms in the same role; a, an and the may differ besides."""
    plain = lambda held: F.forall(held, lambda t: among(t["lower"], DETERMINERS))
    real = F.filter(found, lambda c: ~(plain(c["a"]) & plain(c["b"])))
    one = F.get(real, 0)
    x, y = F.get(one["a"], 0), F.get(one["b"], 0)
    lone = (F.size(real) == 1) & (one["tag"] == "replace") & (F.size(one["a"]) == 1) & (F.size(one["b"]) == 1)
    return F.coalesce(lone & (x["dep"] == y["dep"]) & are_antonyms(relation, x, y), F.lit(False))


def not_antonym_cancels(relation: P.Antonyms, a: Column, b: Column, found: Column) -> Column:
    """Whether one side has a negator more and the only other change is one swap of antonyms: not an evil idea, a good idea."""
    negs = lambda tok: F.size(F.filter(tok, lambda t: among(t["lower"], NEGATORS)))
    content = lambda held: F.filter(held, lambda t: ~among(t["lower"], NEGATORS + DETERMINERS) & ~t["pos"].isin("AUX", "PART"))
    kept = F.transform(found, lambda c: F.struct(content(c["a"]).alias("a"), content(c["b"]).alias("b")))
    real = F.filter(kept, lambda c: (F.size(c["a"]) > 0) | (F.size(c["b"]) > 0))
    swap = lambda c: (F.size(c["a"]) == 1) & (F.size(c["b"]) == 1) & are_antonyms(relation, F.get(c["a"], 0), F.get(c["b"], 0))
    return (negs(a) != negs(b)) & (F.size(real) == 1) & F.coalesce(swap(F.get(real, 0)), F.lit(False))


def antonym_swap(relation: P.Antonyms) -> Column:
    """A function of two texts: whether a word that differs between them is an antonym of one that it replaces."""
    pairs = {frozenset((a, b)) for a, _, b in relation}

    @F.arrow_udf(BooleanType())
    def swapped(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            xs, ys = (re.findall(r"[a-z']+", (s or "").lower()) for s in (x, y))
            codes = difflib.SequenceMatcher(a=xs, b=ys, autojunk=False).get_opcodes()
            out.append(any(frozenset((v, w)) in pairs for tag, i, j, k, m in codes if tag == "replace" for v in xs[i:j] for w in ys[k:m]))
        return pa.array(out, pa.bool_())

    return swapped


def negation_type(a: Column, b: Column, source: Column, swapped: Column) -> Column:
    """antonym, verbal or other: how a pair of sentences is a negation."""
    return F.when(source == "antonym-substitution", "antonym").when(X.cue_count(a) != X.cue_count(b), "verbal").when(swapped, "antonym").otherwise("other")


def kind(dataset: Column, family: Column, subtype: Column, source: Column) -> Column:
    """The category that breakdowns go by."""
    own = F.when(family == "K1_cancellation", "K1").when(family == "ANCHOR_paraphrase", "ours_paraphrase").when(family == "ANCHOR_unrelated", "ours_unrelated").otherwise("ours_negation")
    human = (subtype == "paraphrase") & (source == "antonym-substitution")
    return F.when(dataset == "ours", own).when(dataset == "xnot360", F.concat(F.lit("xnot360_"), subtype)).when(human, "SemAntoNeg").otherwise(subtype)


def gold_three_way(subtype: Column) -> Column:
    """negation, agrees or unrelated."""
    return F.when(subtype == "negation", "negation").when(subtype.isin("paraphrase", "not_negation"), "agrees").when(subtype.isin("sts_low", "snli_neutral", "random_pair"), "unrelated")


def three_way(max_sim: Column, margin: Column, unrelated: float, negation: float) -> Column:
    """unrelated below a similarity, else negation from a margin on, else agrees."""
    return F.when(max_sim < unrelated, "unrelated").when(margin >= negation, "negation").otherwise("agrees")
