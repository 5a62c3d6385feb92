"""What is said of many variants: counts, reference sets, coverage of gold negations, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import lexicons, text as X
from tessera.functions.parsed import Antonyms
from tessera.functions.tables import looked_up
from tessera.operators import affirmations, generators


def counts(records: DataFrame) -> DataFrame:
    """(part, value, n) by family, subtype, net_negation, operation and input: one pass of grouping sets."""
    keyed = records.select(
        "family", F.concat_ws("/", "family", "subtype").alias("subtype"), F.col("net_negation").cast("string").alias("net_negation"), "operation", F.concat_ws("/", "clause_type", "input_polarity").alias("input")
    )
    names = keyed.columns
    sets = keyed.groupingSets([[n] for n in names], *names).agg(F.count("*").alias("n"), F.grouping_id(*names).alias("g"))
    place = lambda k: F.col("g") == 31 - (1 << (4 - k))
    part = F.coalesce(*[F.when(place(k), n) for k, n in enumerate(names)])
    return sets.select(part.alias("part"), F.coalesce(*names).alias("value"), "n")


def reference_sets(records: DataFrame) -> DataFrame:
    """One row per base: n_variants, neg and same (variants whose parity of negations is another than the input's, or its own),
    coverage_fail (no neg)."""
    flipped = (F.col("net_negation") % 2) != (F.col("input_cue_count") % 2)
    # a base has a bounded number of variants: rules times tokens
    sets = records.groupBy("base_id").agg(
        F.count("*").alias("n_variants"), F.sort_array(F.collect_list(F.when(flipped, F.col("variant")))).alias("neg"), F.sort_array(F.collect_list(F.when(~flipped, F.col("variant")))).alias("same")
    )
    return sets.withColumn("coverage_fail", F.size("neg") == 0)


def negations_of(sentences: DataFrame, relation: Antonyms | None = None) -> DataFrame:
    """(sent_id, text, family): stage-1 variants that flip the parity, and affirmations that flip a negated sentence, distinct."""
    made = generators.generate(sentences, relation, stages=(1,))
    flips = made.where((F.col("net_negation") % 2) != (F.col("input_cue_count") % 2)).select(F.col("base_id").alias("sent_id"), F.col("variant").alias("text"), "family", F.lit(0).alias("part"))
    cued = generators.analysed(sentences, relation).where(F.col("profile.existing_count") % 2 == 1).select("sent_id")
    said = affirmations.affirmations(sentences, relation).where("polarity_flip").join(cued, "sent_id")
    own = said.select("sent_id", "text", F.when(F.col("approximate"), "N_affirmation_approx").otherwise("N_affirmation").alias("family"), F.lit(1).alias("part"))
    both = flips.unionByName(own).join(sentences.select("sent_id", F.col("text").alias("base")), "sent_id").where("text <> base")
    return both.groupBy("sent_id", "text").agg(F.min_by("family", F.struct("part", "family")).alias("family"))


def _overlap(a: Column, b: Column) -> Column:
    return X.overlap(X.token_set(a), X.token_set(b))


def family_overlaps(negations: DataFrame) -> DataFrame:
    """(family, n, mean, median, below_04, below_06) of the word overlap of bases and their negations (base, text, family)."""
    o = negations.select("family", _overlap(F.col("base"), F.col("text")).alias("o"))
    below = lambda t: F.round(F.avg((F.col("o") < t).cast("double")), 4)
    return o.groupBy("family").agg(
        F.count("*").alias("n"), F.round(F.avg("o"), 3).alias("mean"), F.round(F.percentile("o", 0.5), 3).alias("median"), below(0.4).alias("below_04"), below(0.6).alias("below_06")
    )


def coverage(gold: DataFrame, negations: DataFrame) -> DataFrame:
    """(n, no_variant, exact, at_09, at_08, at_07) of gold negations (id, base, text) by the best overlap with a generated one."""
    near = gold.alias("g").join(negations.select("base", F.col("text").alias("v")), "base", "left")
    rated = near.withColumn("o", _overlap(F.col("text"), F.col("v"))).withColumn("same", X.alnum_key(F.col("text")) == X.alnum_key(F.col("v")))
    best = rated.groupBy("id").agg(F.max("o").alias("o"), F.coalesce(F.max("same"), F.lit(False)).alias("same"), F.count("v").alias("k"))
    share = lambda t: F.round(F.avg(F.coalesce((F.col("o") >= t).cast("double"), F.lit(0.0))), 4)
    return best.agg(F.count("*").alias("n"), F.count_if(F.col("k") == 0).alias("no_variant"), F.count_if("same").alias("exact"), share(0.9).alias("at_09"), share(0.8).alias("at_08"), share(0.7).alias("at_07"))


def inventory(readings: DataFrame) -> DataFrame:
    """(kind, n, primary_n, approximate_n) of affirmations by the type of cue."""
    return readings.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("primary").alias("primary_n"), F.count_if("approximate").alias("approximate_n"))


def grouped(family: Column) -> Column:
    """The group of a family."""
    return looked_up(lexicons.FAMILY_GROUPS, family)


# conditional templates

# The pairs of a conditional, as (type, side, form, label); p, q and their negations stand in braces, capitals
# for a first letter that is one.
TEMPLATES = [
    ("antecedent flip", "preposed", "If {np}, {q}.", 0), ("inverse", "preposed", "If {np}, {nq}.", 0), ("consequent flip", "preposed", "If {p}, {nq}.", 1),
    ("logical negation", "fact", "{P}, but {nq}.", 1), ("contrapositive", "preposed", "If {nq}, {np}.", 0), ("unless", "preposed", "Unless {p}, {q}.", 0),
    ("even if", "preposed", "Even if {np}, {q}.", 0), ("only if", "postposed", "{Q} only if {p}.", 0), ("antecedent flip", "postposed", "{Q} if {np}.", 0),
    ("inverse", "postposed", "{NQ} if {np}.", 0), ("consequent flip", "postposed", "{NQ} if {p}.", 1), ("contrapositive", "postposed", "{NP} if {nq}.", 0),
]


def conditional_pairs(contents: DataFrame) -> DataFrame:
    """(topic, a, b, label, kind, template): every content (topic, p, np, q, nq) in every template, against its plain conditional."""
    spec = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(s).alias("side"), F.lit(f).alias("form"), F.lit(y).alias("label")) for t, s, f, y in TEMPLATES])
    up = lambda c: F.concat(F.upper(F.substr(c, F.lit(1), F.lit(1))), F.substr(c, F.lit(2)))
    parts = {f"{{{n}}}": F.col(n) for n in ("np", "nq", "p", "q")} | {f"{{{n.upper()}}}": up(F.col(n)) for n in ("np", "nq", "p", "q")}

    def filled(form: Column) -> Column:
        for name, value in parts.items():
            form = F.replace(form, F.lit(name), value)
        return form

    after = (F.col("x.side") == "postposed") & (F.col("x.type") != "only if")
    a = filled(F.when(after, "{Q} if {p}.").otherwise("If {p}, {q}."))
    kind = F.concat(F.lit("cond_"), F.replace(F.col("x.type"), F.lit(" "), F.lit("_")))
    rows = contents.withColumn("x", F.explode(spec))
    return rows.select("topic", a.alias("a"), filled(F.col("x.form")).alias("b"), "x.label", kind.alias("kind"), F.concat_ws("|", "x.type", "x.side").alias("template"))
