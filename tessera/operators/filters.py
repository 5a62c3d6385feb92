"""The filters of variants, cheapest first, with the reason of every drop kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.functions import lexicons, parsed as P, text as X

ORDER = ["gen_ord", "cand_ord"]


def tagged(made: DataFrame, per_family: bool = False) -> DataFrame:
    """Adds drop_reason: identical_to_base (also an empty key), duplicate (of an earlier variant of the base, with
    per_family of the same family), the first blacklist pattern that the variant holds more often than its base, else null.

    Of equal variants the one of least gen_ord and cand_ord stays, so that reruns agree.
    """
    key = X.dedup_key(F.col("variant"))
    keyed = made.withColumns({"_key": key, "_same": (key == X.dedup_key(F.col("base_sentence"))) | (key == "")})
    place = F.row_number().over(W.partitionBy("base_id", "_key", "_same", *(["family"] if per_family else [])).orderBy(*ORDER))
    reason = F.when(F.col("_same"), "identical_to_base").when(place > 1, "duplicate").otherwise(X.blacklist_hit(F.col("variant"), F.col("base_sentence")))
    return keyed.withColumn("drop_reason", reason).drop("_key", "_same")


def parse_checked(kept: DataFrame, variants: DataFrame, bases: DataFrame, relation: P.Antonyms | None = None) -> DataFrame:
    """Adds drop_reason 'invalid_parse' or null to variants that were parsed again.

    `variants` has (base_id, variant, tok), `bases` (base_id, tok). Before that the depth guardrail holds: a variant with
    more cues than its input had and its operation adds raises an error, as a rule broke its contract.
    """
    relation = lexicons.prefixed_antonyms() if relation is None else relation
    tok = F.col("variant_tok")
    cues = F.size(P.existing_cues(relation, tok, F.col("variant")))
    depths = bases.select("base_id", P.tree_depth(F.col("tok")).alias("base_depth"))
    joined = kept.join(variants.select("base_id", "variant", F.col("tok").alias("variant_tok")), ["base_id", "variant"]).join(depths, "base_id")
    broken = cues > F.col("input_cue_count") + F.col("op_depth")
    said = F.concat(F.lit("more cues than the operation adds: "), F.col("variant"))
    reason = F.when(broken, F.raise_error(said)).when(~P.is_tree(tok, F.col("base_depth")), "invalid_parse")
    return joined.withColumn("drop_reason", reason.cast("string")).drop("variant_tok", "base_depth")


def kept(made: DataFrame, per_family: bool = False) -> DataFrame:
    """The variants that no text filter drops."""
    return tagged(made, per_family).where("drop_reason IS NULL").drop("drop_reason")


def report(made: DataFrame) -> DataFrame:
    """(reason, n) of tagged variants; what stays counts as kept."""
    return made.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


# What a record may say.
ALLOWED = {
    "scope_target": ["subject", "predicate", "clause"],
    "intensity_hint": ["neutral", "hedged", "intensified", "partial"],
    "operation": ["negate", "affirm", "rescope"],
    "clause_type": ["declarative", "interrogative", "imperative", "exclamative"],
    "voice": ["active", "passive"],
    "input_polarity": ["affirmative", "negated"],
}
MOST_DEPTH = 2


def valid(records: DataFrame) -> DataFrame:
    """The records, with an error for one whose closed columns, depth or confidence are out of range; nulls pass."""
    checks = [F.when(~F.col(c).isin(v), c) for c, v in ALLOWED.items()]
    checks += [F.when((F.col("depth") > MOST_DEPTH) | (F.col("depth") < 0), "depth"), F.when(~F.col("confidence").between(0, 1), "confidence")]
    wrong = F.coalesce(*checks)
    return records.where(F.when(wrong.isNotNull(), F.raise_error(F.concat(F.lit("bad value in "), wrong)).cast("boolean")).otherwise(True))
