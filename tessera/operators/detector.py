"""The detector of negated pairs: a cascade of stages, and the combiner with its override, low-overlap rule and guardrail.

Model outputs come as columns: nli_c, nli_e, nli_n (probabilities), cos and c_resid (similarities), prob (the combiner's).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Score of a pair that was stopped before a model: below every probability.
STOPPED = -1.0
#: Gate thresholds that are tried, and the part of the negations that a gate must let pass.
GRID = [round(k / 100, 2) for k in range(100)]
LEAST_RECALL = 0.95
Buckets = Sequence[tuple[int | None, float]]


def gate_fit(dev: DataFrame, sim: str, nli_threshold: float, label: str = "label", nli: str = "nli_c", split: str = "split") -> DataFrame:
    """(t1, gate_recall, j): the gate of greatest Youden's J of gate and model among those that keep LEAST_RECALL of the
    negations, the lowest of several. Rows of another split than dev raise an error; one pass over the rows."""
    own = F.when(F.col(split) != "dev", F.raise_error(F.lit("a threshold is fitted on dev alone")).cast("double")).otherwise(F.col(sim))
    tried = dev.select(own.alias("s"), F.col(label).alias("y"), (F.col(nli) >= nli_threshold).alias("hit"), F.explode(F.array(*map(F.lit, GRID))).alias("t1"))
    passed = F.col("s") >= F.col("t1")
    rate = lambda test, y: F.avg(F.when(F.col("y") == y, test.cast("double")))
    rated = tried.groupBy("t1").agg(rate(passed, 1).alias("gate_recall"), F.round(rate(passed & F.col("hit"), 1) - rate(passed & F.col("hit"), 0), 4).alias("j"))
    best = rated.where(F.col("gate_recall") >= LEAST_RECALL).agg(F.max(F.struct("j", (-F.col("t1")).alias("low"), F.round("gate_recall", 4).alias("gate_recall"))).alias("x"))
    return best.select((-F.col("x.low")).alias("t1"), "x.gate_recall", "x.j")


def gate_threshold(len_a: Column, len_b: Column, buckets: Buckets, t1: float) -> Column:
    """The threshold of the first bucket that the shorter sentence falls in; a bucket up to None takes the rest."""
    out = None
    for upper, value in buckets:
        fits = F.lit(True) if upper is None else F.least(len_a, len_b) <= upper
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(t1) if out is None else out


def cascade(gate: Column, vetoed: Column, nli: Column) -> tuple[Column, Column]:
    """(score, stage): 1 stopped by the gate, 2 vetoed, 3 left to the model, whose score counts only there."""
    stage = F.when(~gate, 1).when(vetoed, 2).otherwise(3)
    return F.when(stage == 3, nli).otherwise(STOPPED), stage


def stages(decision: Column, bypass: Column, gate: Column, vetoed: Column, nli: Column, both: str | None = "negation", cons: str | None = "negation") -> tuple[Column, Column]:
    """(score, stage) of the cascade with conditionals: 4 not a negation, 5 a negation (above every probability), 0 past the
    gate by an antonym, then gate, veto and model. `both` and `cons` say what flips of both halves and of the second mean."""
    mapped = F.when(decision == "contraposition", F.lit(both)).when(decision == "negation", F.lit(cons)).otherwise(decision)
    stage = F.when(mapped == "not_negation", 4).when(mapped == "negation", 5).when(bypass, 0).when(~gate, 1).when(vetoed, 2).otherwise(3)
    return F.when(stage.isin(0, 3), nli).when(stage == 5, nli + 1).otherwise(STOPPED), stage


def low_overlap_fires(overlap: Column, nli: Column, cos: Column, overridden: Column, theta: float, rho: float, kappa: float | None = None) -> Column:
    """Whether a pair of few words in common is a negation by the model alone."""
    fires = (overlap < theta) & (nli > rho) & ~overridden
    return fires if kappa is None else fires & (cos >= kappa)


def guarded(score: Column, threshold: float, margin: Column, delta: float) -> Column:
    """The score, stopped where a negation's margin is delta at most; without a margin the guard abstains."""
    return F.when((score >= threshold) & margin.isNotNull() & (margin <= delta), STOPPED).otherwise(score)


def margin(similarities: Column, original: Column, how: str = "max") -> Column:
    """How much nearer a sentence is to the generated negations (the nearest, or the mean of three) than to the original."""
    ordered = F.sort_array(similarities, asc=False)
    three = F.slice(ordered, 1, 3)
    near = F.get(ordered, 0) if how == "max" else F.aggregate(three, F.lit(0.0), lambda s, x: s + x) / F.size(three)
    return F.when(F.size(similarities) > 0, near - original)


def predict(rows: DataFrame, threshold: float, rule: dict | None = None, delta: float | None = None) -> DataFrame:
    """Adds stage and negation to rows with prob, override, token_overlap, nli_c, cos and margin.

    First rule that holds: an override says no, the combiner's no is lifted by the low-overlap rule, its yes is taken back
    by the guardrail, else the combiner decides.
    """
    yes = F.col("prob") >= threshold
    fires = low_overlap_fires(F.col("token_overlap"), F.col("nli_c"), F.col("cos"), F.lit(False), **rule) if rule else F.lit(False)
    down = (F.col("margin") <= delta) if delta is not None else F.lit(False)
    stage = (
        F.when(F.col("override"), "cancellation override")
        .when(~yes & fires, "low-overlap NLI override")
        .when(yes & F.coalesce(down, F.lit(False)), "guardrail downgrade")
        .otherwise("combiner")
    )
    return rows.withColumn("stage", stage).withColumn("negation", (F.col("stage") == "low-overlap NLI override") | ((F.col("stage") == "combiner") & yes))


def extended(features: Column, others: Sequence[Column]) -> Column:
    """The feature row with three probabilities of each further model behind it."""
    return F.concat(features, *others)


def mean_probabilities(features: Column, every: Sequence[Column]) -> Column:
    """The feature row with the models' mean probabilities in place of the second to fourth feature."""
    means = [sum(p[k] for p in every) / len(every) for k in range(3)]
    return F.transform(features, lambda x, i: F.when(i == 1, means[0]).when(i == 2, means[1]).when(i == 3, means[2]).otherwise(x))


def contributions(features: Column, medians: list[float], weights: list[float], bias: float, names: list[str], top: int = 6) -> Column:
    """(name, change): what each feature adds to a logistic score against its median, the `top` of greatest size."""
    logit = F.aggregate(F.zip_with(features, F.array(*map(F.lit, weights)), lambda x, w: x * w), F.lit(bias), lambda s, x: s + x)
    prob = lambda z: 1 / (1 + F.exp(-z))
    spec = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(m).alias("median"), F.lit(w).alias("weight")) for n, m, w in zip(names, medians, weights)])
    changes = F.zip_with(features, spec, lambda x, f: F.struct(f["name"].alias("name"), (prob(logit) - prob(logit - (x - f["median"]) * f["weight"])).alias("change")))
    order = F.array_sort(changes, lambda a, b: F.signum(F.abs(b["change"]) - F.abs(a["change"])).cast("int"))
    return F.slice(order, 1, top)


def rule_surface(rows: DataFrame, thetas: Sequence[float], rhos: Sequence[float], kappa: float | None, threshold: float) -> DataFrame:
    """(theta, rho, accuracy) of the low-overlap rule over a grid, on all rows at once; rows have score, label and override."""
    grid = [F.struct(F.lit(t).alias("theta"), F.lit(r).alias("rho")) for t in thetas for r in rhos]
    tried = rows.withColumn("g", F.explode(F.array(*grid)))
    fires = (F.col("token_overlap") < F.col("g.theta")) & (F.col("nli_c") > F.col("g.rho")) & ~F.col("override")
    fires = fires if kappa is None else fires & (F.col("cos") >= kappa)
    right = (fires | (F.col("score") >= threshold)) == (F.col("label") == 1)
    return tried.groupBy(F.col("g.theta").alias("theta"), F.col("g.rho").alias("rho")).agg(F.round(F.avg(right.cast("double")), 4).alias("accuracy"))


def error_bucket(r: dict[str, Column]) -> Column:
    """What kind of error a wrong pair is, by its data set, its prediction and its features."""
    both, cue = r["has_conditional_a"] & r["has_conditional_b"], (r["cue_count_a"], r["cue_count_b"])
    statutes = (
        F.when(both & r["predicted"], "xNot360: both sides conditional (inverse / antecedent flip read as negation)")
        .when(both, "xNot360: conditional negation missed")
        .when(r["has_conditional_a"], "xNot360: conditional restated as a fact (P and not Q) — misjudged")
        .otherwise("xNot360: non-conditional legal / policy pair")
    )
    false_positive = (
        F.when(r["kind"].isin("sts_low", "snli_neutral", "random_pair"), "topically related, different claim (STS-low / SNLI neutral)")
        .when((r["kind"] == "SemAntoNeg") | (cue[0] != cue[1]), "paraphrase that swaps a cue for an antonym (polarity changes, meaning kept)")
        .otherwise("paraphrase with a content change (lexical rewording read as contradiction)")
    )
    missed = (
        F.when(r["antonym_aligned"] | (r["neg_type"] == "antonym"), "antonym negation missed")
        .when((cue[0] >= 2) | (cue[1] >= 2) | ((cue[0] > 0) & (cue[1] > 0)), "cue on both sides / double negation")
        .when(r["neg_type"] == "verbal", "verbal negation missed (single cue)")
        .otherwise("lexical substitution, no cue on either side (CANNOT 'other')")
    )
    return F.when(r["dataset"] == "xnot360", statutes).when(r["predicted"], false_positive).otherwise(missed)


def adopted(systems: DataFrame, base: str) -> DataFrame:
    """The system of greatest summed gain among those that lose on neither measure; rows have system, validation and ood."""
    own = F.broadcast(systems.where(F.col("system") == base).select(F.col("validation").alias("v"), F.col("ood").alias("o")))
    gain = F.round(F.col("validation") - F.col("v") + F.col("ood") - F.col("o"), 6)
    fit = systems.crossJoin(own).where("validation >= v AND ood >= o").withColumn("gain", gain)
    best = fit.agg(F.max(F.struct("gain", (F.col("system") == base).alias("same"), "system")).alias("x"))
    return best.select("x.system", "x.gain")


def evaluation(rows: DataFrame, threshold: float) -> DataFrame:
    """(part, value, n, accuracy, fpr, recall) of scored pairs: of all, by data set, by kind and by type, in one pass.

    rows have label, score, dataset, kind and neg_type. fpr is of pairs that are no negations, recall of those that are.
    """
    hit = (F.col("score") >= threshold).cast("double")
    rated = rows.select("label", "dataset", "kind", "neg_type", hit.alias("hit"), (hit == F.col("label")).cast("double").alias("right"))
    measures = [
        F.count("*").alias("n"), F.round(F.avg("right"), 4).alias("accuracy"), F.round(F.avg(F.when(F.col("label") == 0, F.col("hit"))), 4).alias("fpr"),
        F.round(F.avg(F.when(F.col("label") == 1, F.col("hit"))), 4).alias("recall"),
    ]
    sets = rated.groupingSets([[], ["dataset"], ["kind"], ["neg_type"]], "dataset", "kind", "neg_type").agg(*measures, F.grouping_id("dataset", "kind", "neg_type").alias("g"))
    part = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, "dataset").when(F.col("g") == 5, "kind").otherwise("neg_type")
    value = F.when(F.col("g") == 7, "all").otherwise(F.coalesce("dataset", "kind", "neg_type"))
    return sets.select(part.alias("part"), value.alias("value"), "n", "accuracy", "fpr", "recall").where("value IS NOT NULL")


def override(cancels_ab: Column, cancels_ba: Column, by_antonym: Column) -> Column:
    """Whether a pair is no negation whatever the model says: either side cancels its own, or an antonym cancels the negator."""
    return cancels_ab | cancels_ba | by_antonym
