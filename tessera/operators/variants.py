"""Variants of sentences by rules that closed-class words license: a table function with full provenance.

There is no parser here, so rules read the surface: the first auxiliary, quantifiers, negative adverbs and negators.
Each variant differs from its base in one operation and carries its cues' character spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.functions import lexicons, text

COPULAS = ("am", "is", "are", "was", "were")
PERFECT = ("have", "has", "had")
MODALS = tuple(lexicons.MODALITY)
SUBJECTS = ("i", "you", "he", "she", "it", "we", "they")
PIECE = re.compile(r"\w+(?:['’]\w+)*|[^\w\s]")
Made = tuple[str, str, str, str, str, list[str]]  # generator, family, subtype, operation, variant, cues


def _join(tokens: list[str]) -> str:
    out = " ".join(t for t in tokens if t)
    out = re.sub(r" ([,.;:!?])", r"\1", out)
    return out[:1].upper() + out[1:] if tokens and tokens[0][:1].isupper() or not tokens[0] else out


def _negate_aux(tokens: list[str], low: list[str]) -> Iterator[Made]:
    """not after the first auxiliary of a sentence without a cue; can not is written cannot."""
    if any(w in lexicons.EXPLICIT_CUES for w in low):
        return
    participle = {row[2] for row in lexicons.IRREGULAR_VERBS}
    perfect = lambda i: low[i] in PERFECT and i + 1 < len(low) and (low[i + 1].endswith("ed") or low[i + 1] in participle)
    at = next((i for i, w in enumerate(low) if w in COPULAS or w in MODALS or perfect(i)), None)
    if at is None or at == 0:
        return
    kind = "copula" if low[at] in COPULAS else "existing_aux"
    if low[at] == "can":
        yield "aux_not", "syntactic", kind, "negate", _join([*tokens[:at], "cannot", *tokens[at + 1 :]]), ["cannot"]
    else:
        yield "aux_not", "syntactic", kind, "negate", _join([*tokens[: at + 1], "not", *tokens[at + 1 :]]), ["not"]


_PAST = {row[1]: row[0] for row in lexicons.IRREGULAR_VERBS if row[0] not in ("be", "have", "do")}
_BASE = {row[0] for row in lexicons.IRREGULAR_VERBS} - {"be", "have", "do"}


def _negate_do(tokens: list[str], low: list[str]) -> Iterator[Made]:
    """do-support after a pronoun subject and a verb of the irregular table."""
    if any(w in lexicons.EXPLICIT_CUES or w in COPULAS or w in MODALS for w in low):
        return
    for i, (subject, verb) in enumerate(zip(low, low[1:])):
        if subject not in SUBJECTS:
            continue
        third = verb[:-2] if verb.endswith("es") and verb[:-2] in _BASE else verb[:-1] if verb.endswith("s") and verb[:-1] in _BASE else None
        if verb in _PAST:
            do, lemma = "did", _PAST[verb]
        elif third:
            do, lemma = "does", third
        elif verb in _BASE:
            do, lemma = "do", verb
        else:
            continue
        yield "do_not", "syntactic", "do_support", "negate", _join([*tokens[: i + 1], do, "not", lemma, *tokens[i + 2 :]]), ["not"]
        return


def _swap_quantifier(tokens: list[str], low: list[str]) -> Iterator[Made]:
    for i, w in enumerate(low):
        if (to := lexicons.QUANTIFIER_SWAPS.get(w)) is None:
            continue
        skip = 2 if w == "all" and i + 1 < len(low) and low[i + 1] in ("the", "these", "those") else 1
        yield "quantifier_swap", "quantifier", f"{w}_to_{to.split()[0]}", "negate", _join([*tokens[:i], text_case(to, tokens[i]), *tokens[i + skip :]]), [to]


def _inflected(lemma: str, tag: str) -> str:
    """A lemma as VBP, VBZ or VBD."""
    if tag == "VBD":
        regular = lemma + "d" if lemma.endswith("e") else lemma[:-1] + "ied" if re.search("[^aeiou]y$", lemma) else lemma + lemma[-1] + "ed" if re.search("[^aeiou][aeiou][^aeiouwxy]$", lemma) else lemma + "ed"
        return {row[0]: row[1] for row in lexicons.IRREGULAR_VERBS}.get(lemma, regular)
    if tag == "VBZ":
        return {"be": "is", "have": "has"}.get(lemma) or (lemma[:-1] + "ies" if re.search("[^aeiou]y$", lemma) else lemma + "es" if re.search("(?:s|x|z|ch|sh|o)$", lemma) else lemma + "s")
    return lemma


def text_case(word: str, model: str) -> str:
    return word[:1].upper() + word[1:] if model[:1].isupper() else word


def _insert_adverb(tokens: list[str], low: list[str]) -> Iterator[Made]:
    if any(w in lexicons.EXPLICIT_CUES for w in low):
        return
    at = next((i for i, w in enumerate(low) if w in COPULAS or w in MODALS), None)
    if at is None:
        at = next((i for i, w in enumerate(low[:-1]) if w in SUBJECTS and low[i + 1].isalpha()), None)
    if at is None:
        return
    for adverb, (_, hint) in lexicons.NEGATIVE_ADVERBS.items():
        yield "adverb", "neg_adverb", hint, "negate", _join([*tokens[: at + 1], adverb, *tokens[at + 1 :]]), [adverb]


def _affirm(tokens: list[str], low: list[str]) -> Iterator[Made]:
    """Takes out exactly one negator: not, n't and cannot, quantifiers, adverbs."""
    for i, w in enumerate(low):
        if w == "not" and i and low[i - 1] in lexicons.DO_FORM_TAGS and i + 1 < len(low) and low[i + 1].isalpha():
            # the do goes too, and the verb gets its tense back
            verb = _inflected(low[i + 1], lexicons.DO_FORM_TAGS[low[i - 1]])
            yield "strip_not", "syntactic", "collapse_do_support", "affirm", _join([*tokens[: i - 1], text_case(verb, tokens[i - 1]), *tokens[i + 2 :]]), []
        elif w == "not":
            yield "strip_not", "syntactic", "not", "affirm", _join(tokens[:i] + tokens[i + 1 :]), []
        elif w == "cannot":
            yield "strip_not", "syntactic", "cannot", "affirm", _join([*tokens[:i], text_case("can", tokens[i]), *tokens[i + 1 :]]), []
        elif w.endswith(("n't", "n’t")):
            aux = {"ca": "can", "wo": "will", "sha": "shall"}.get(w[:-3], w[:-3])
            yield "strip_not", "syntactic", "contracted", "affirm", _join([*tokens[:i], text_case(aux, tokens[i]), *tokens[i + 1 :]]), []
        elif w in lexicons.ADVERB_AFFIRMATIONS:
            for to in lexicons.ADVERB_AFFIRMATIONS[w]:
                yield "adverb_affirm", "neg_adverb", f"{w}_to_{to or 'none'}", "affirm", _join([*tokens[:i], text_case(to, tokens[i]), *tokens[i + 1 :]]), []
        elif w in lexicons.QUANTIFIER_FLIPS:
            to = lexicons.QUANTIFIER_FLIPS[w]
            yield "quantifier_flip", "quantifier", f"{w}_to_{to}", "affirm", _join([*tokens[:i], text_case(to, tokens[i]), *tokens[i + 1 :]]), []


#: Rules in the order in which their variants win against equal later ones.
RULES: list[Callable[[list[str], list[str]], Iterator[Made]]] = [_negate_aux, _negate_do, _swap_quantifier, _insert_adverb, _affirm]


def variants_of(sentence: str) -> list[tuple[str, str, str, str, str, list[str], list[list[int]]]]:
    """All rules' variants of one sentence, with the character spans of their cues."""
    tokens = PIECE.findall(sentence)
    low = [t.lower() for t in tokens]
    out = []
    for rule in RULES:
        for generator, family, subtype, operation, variant, cues in rule(tokens, low) if tokens else ():
            found = [re.search(rf"(?<!\w){re.escape(c)}(?!\w)", variant, re.I) for c in cues]
            spans = [[m.start(), m.end()] for m in found if m]
            out.append((generator, family, subtype, operation, variant, [variant[a:b] for a, b in spans], spans))
    return out


SHAPE = (
    "base_id string, base_sentence string, gen_ord int, generator string, family string, subtype string, operation string, variant string, "
    "cue_tokens array<string>, cue_char_spans array<array<int>>"
)


def generate(sentences: DataFrame, id_col: str = "base_id", text_col: str = "sentence") -> DataFrame:
    """All variants of the sentences, before filters. Null and blank sentences have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, s, k, *v) for i, s in zip(*(c.to_pylist() for c in batch.columns)) for k, v in enumerate(variants_of(s or ""))]
            kinds = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * 5, pa.list_(pa.string()), pa.list_(pa.list_(pa.int32()))]
            columns = list(zip(*rows)) if rows else [[]] * 10
            names = [f.split()[0] for f in SHAPE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return sentences.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, SHAPE)


def tagged(made: DataFrame) -> DataFrame:
    """Adds drop_reason: identical_to_base, duplicate (first wins), a pattern's name, or null for what stays."""
    keyed = made.withColumn("key", text.dedup_key(F.col("variant")))
    same = (F.col("key") == text.dedup_key(F.col("base_sentence"))) | (F.col("key") == "")
    place = F.row_number().over(W.partitionBy("base_id", "key").orderBy("gen_ord"))
    reason = F.when(same, "identical_to_base").when(place > 1, "duplicate").otherwise(text.blacklist_hit(F.col("variant"), F.col("base_sentence")))
    return keyed.withColumn("drop_reason", reason).drop("key")


def run(sentences: DataFrame, id_col: str = "base_id", text_col: str = "sentence") -> DataFrame:
    """The variants that pass all filters, with net_negation: overt cues after the operation, 2 at most."""
    kept = tagged(generate(sentences, id_col, text_col)).where("drop_reason IS NULL").drop("drop_reason", "gen_ord")
    # overt cues of the variant: those that it brings and those that stay
    return kept.withColumn("net_negation", F.least(F.size(F.filter(text.words(F.col("variant")), lambda w: w.isin(lexicons.EXPLICIT_CUES) | w.endswith("n't"))), F.lit(2)))
