"""Verdict columns: keys, three-valued outcomes, tolerant reading of judges' answers, cache of verdicts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Names under which judges wrap their answers.
ENVELOPES = ["verdicts", "results", "items", "output", "data", "judgements"]


def verdict_key(base: Column, variant: Column, family: Column) -> Column:
    """The digest that names a judgement."""
    return F.sha2(F.concat_ws("\x1f", base, variant, family), 256)


def all_three(*questions: Column) -> Column:
    """True if all are, false if one is false, null if one is unanswered otherwise."""
    out = questions[0]
    for q in questions[1:]:
        out = out & q
    return out


def reasons(named: dict[str, Column]) -> Column:
    """Names of the questions answered with no, joined by +; unanswered ones don't count."""
    return F.concat_ws("+", *[F.when(~q, F.lit(name)) for name, q in named.items()])


def as_bool(value: Column) -> Column:
    """yes / true / 1 and no / false / 0 in any case; null for all else."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("true", "yes", "y", "1"), True).when(v.isin("false", "no", "n", "0"), False)


def as_confidence(value: Column) -> Column:
    """A number, moved into [0, 1]; null if it is none."""
    x = value.try_cast("double")
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def answer_rows(raw: Column) -> Column:
    """The JSON array of a judge's answer: fences off, the first envelope that holds one, or the answer itself."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    inside = [F.get_json_object(bare, f"$.{name}") for name in ENVELOPES]
    return F.coalesce(F.when(bare.startswith("["), bare), *inside, F.when(bare.startswith("{"), F.concat(F.lit("["), bare, F.lit("]"))))


def upsert(cache: DataFrame, fresh: DataFrame, keys: list[str], judged: str) -> DataFrame:
    """The cache with fresh judged rows in place of older ones of the same keys; unjudged rows never enter."""
    new = fresh.where(F.col(judged).isNotNull())
    return cache.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def split_by_cache(todo: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits with the cache's columns, misses)."""
    return todo.join(cache, keys), todo.join(cache, keys, "left_anti")


# the run: a cheap score first, then a judge for what it lets pass

Scorer = Callable[[list[str]], list[float]]
#: A judge answers prompts with text; it may fail.
Judge = Callable[[str], str]
VERDICT = (
    "verified boolean, verify_grammatical boolean, verify_semantic boolean, verify_category boolean, suggested_family string, verify_reason string, "
    "verify_model string, verify_confidence double, cola_score double"
)
VERDICT_COLUMNS = [f.split()[0] for f in VERDICT.split(", ")]
PASS, COLA_REJECT, LLM_REJECT, PARSE_FAILURE, CACHED = "pass", "cola_reject", "llm_reject", "llm_parse_failure", "cached"
QUESTIONS = ["grammatical", "semantic", "category"]


def scored(records: DataFrame, scorer: Scorer, text_col: str = "variant") -> DataFrame:
    """Adds cola_score; the scorer gets a batch of texts at a time on the executors."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(scorer([x or "" for x in texts.to_pylist()]), pa.float64())

    return records.withColumn("cola_score", score(F.col(text_col)))


def rejected_columns(score: Column, model: str) -> dict[str, Column]:
    """The verdict of a record below the score's threshold: what no judge has seen stays unanswered."""
    no, text = F.lit(None).cast("boolean"), F.lit(None).cast("string")
    return {
        "verified": F.lit(False), "verify_grammatical": F.lit(False), "verify_semantic": no, "verify_category": no, "suggested_family": text,
        "verify_reason": F.lit(COLA_REJECT), "verify_model": F.lit(model), "verify_confidence": F.lit(None).cast("double"), "cola_score": score,
    }


def tier_one(records: DataFrame, threshold: float, model: str) -> tuple[DataFrame, DataFrame]:
    """(rejected with their verdict, survivors) of records with a cola_score; scores below the threshold are rejected."""
    bare = records.drop(*[c for c in VERDICT_COLUMNS if c != "cola_score"])
    return bare.where(F.col("cola_score") < threshold).withColumns(rejected_columns(F.col("cola_score"), model)), bare.where(F.col("cola_score") >= threshold)


def verdict_reason(grammatical: Column, semantic: Column, category: Column) -> Column:
    """pass, llm_reject:names of what failed, or llm_parse_failure where a question is open and none failed."""
    failed = reasons(dict(zip(QUESTIONS, (grammatical, semantic, category))))
    whole = all_three(grammatical, semantic, category)
    return F.when(whole.isNull(), PARSE_FAILURE).when(whole, PASS).otherwise(F.concat(F.lit(f"{LLM_REJECT}:"), failed))


def prompt(records: Sequence[dict]) -> str:
    """What a judge is asked: the items by number, with what its answer must hold."""
    items = [{"id": k, **{f: r.get(f) for f in ("base_sentence", "variant", "family", "subtype", "net_negation")}} for k, r in enumerate(records)]
    return (
        "Judge each item. grammatical: the variant is well formed. semantic: it differs from the base by as many negations as net_negation says. "
        "category: family names how it does. If not, suggested_family names a better one. Answer with a JSON array of objects with id, grammatical, "
        "semantic, category, suggested_family and confidence from 0 to 1.\n" + json.dumps(items, ensure_ascii=False)
    )


def _flag(value: object) -> bool | None:
    word = str(value).strip().lower()
    return True if word in ("true", "yes", "y", "1") else False if word in ("false", "no", "n", "0") else None


def read_verdicts(raw: str) -> list[dict]:
    """The objects of a judge's answer: of an array, an envelope, a single object, or all that can be read of a cut-off array."""
    bare = re.sub(r"```[a-zA-Z]*", "", raw or "").strip()
    start = min((p for p in (bare.find("["), bare.find("{")) if p >= 0), default=-1)
    if start < 0:
        return []
    reader = json.JSONDecoder()
    try:
        found, _ = reader.raw_decode(bare, start)
    except ValueError:  # cut off: the whole objects in it count
        found, at = [], start + 1
        while (at := bare.find("{", at)) >= 0:
            try:
                item, at = reader.raw_decode(bare, at)
                found.append(item)
            except ValueError:
                at += 1
    if isinstance(found, dict):
        found = next((found[name] for name in ENVELOPES if isinstance(found.get(name), list)), [found])
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


def judged(records: Sequence[dict], judge: Judge, retries: int = 1) -> list[dict | None]:
    """A verdict for each record, null where the judge gives none: whole batches first, again after a failure, then one by one."""
    for _ in range(retries + 1):
        try:
            found = {int(x.get("id", k)): x for k, x in enumerate(read_verdicts(judge(prompt(records)))) if str(x.get("id", k)).lstrip("-").isdigit()}
        except Exception:  # noqa: BLE001  a judge may fail in any way; what it doesn't answer stays open
            found = {}
        if len(found) >= len(records):
            return [found.get(k) for k in range(len(records))]
    if len(records) == 1:
        return [found.get(0)]
    return [found[k] if k in found else judged([r], judge, 0)[0] for k, r in enumerate(records)]


def tier_two(pending: DataFrame, judge: Judge, model: str, families: Sequence[str], batch: int = 20) -> DataFrame:
    """The records with a judge's verdict; the judge gets `batch` of them at a time on the executors.

    A family that isn't known is dropped from a verdict, its rejection stays. Open questions stay null.
    """
    kept = [c for c in pending.columns if c not in VERDICT_COLUMNS or c == "cola_score"]
    own = pending.select(*[f"`{c}`" for c in kept if c != "cola_score"], F.col("cola_score").cast("double").alias("cola_score"))
    answer = "grammatical boolean, semantic boolean, category boolean, suggested string, certainty double"
    shape = own.sparkSession.createDataFrame([], own.schema).select("*", *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in answer.split(", ")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in batches:
            rows = held.to_pylist()
            verdicts = [v for at in range(0, len(rows), batch) for v in judged(rows[at : at + batch], judge)]
            sure = [_number((v or {}).get("confidence")) for v in verdicts]
            named = [(v or {}).get("suggested_family") for v in verdicts]
            columns = [
                *[pa.array([_flag((v or {}).get(q)) for v in verdicts], pa.bool_()) for q in QUESTIONS],
                pa.array([n if n in families else None for n in named], pa.string()),
                pa.array([None if c is None else min(1.0, max(0.0, c)) for c in sure], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*held.columns, *columns], names=[*held.schema.names, *QUESTIONS, "suggested", "certainty"])

    out = own.mapInArrow(run, shape)
    g, s, c = (F.col(q) for q in QUESTIONS)
    return out.withColumns({
        "verified": all_three(g, s, c), "verify_grammatical": g, "verify_semantic": s, "verify_category": c, "suggested_family": F.col("suggested"),
        "verify_reason": verdict_reason(g, s, c), "verify_model": F.lit(model), "verify_confidence": F.col("certainty"),
    }).drop(*QUESTIONS, "suggested", "certainty")


def _number(value: object) -> float | None:
    try:
        return float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


def cached_verdicts(pending: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(records with their cached verdict, records without one): a verdict holds for its key and its model alone.

    `cache` has key, verify_model and the other verdict columns. The reason of a cached verdict says so.
    """
    keyed = pending.withColumn("key", verdict_key(F.col("base_sentence"), F.col("variant"), F.col("family")))
    known = cache.where(F.col("verify_model") == model).drop("cola_score")
    bare = keyed.drop(*[c for c in VERDICT_COLUMNS if c != "cola_score"])
    hits = bare.join(known, "key").withColumn("verify_reason", F.concat_ws("|", "verify_reason", F.lit(CACHED)))
    return hits.drop("key"), bare.join(known.select("key"), "key", "left_anti").drop("key")


def already_verified(record_verified: Column, reason: Column) -> Column:
    """Whether a record has a verdict or a reason from an earlier run."""
    return record_verified.isNotNull() | reason.isNotNull()


def verify(records: DataFrame, scorer: Scorer, judge: Judge, model: str, families: Sequence[str], threshold: float = 0.5, cache: DataFrame | None = None, resume: bool = True) -> DataFrame:
    """Every record with its verdict: earlier ones stay, the score rejects, the cache answers, the judge does the rest."""
    columns = [*[c for c in records.columns if c not in VERDICT_COLUMNS], *VERDICT_COLUMNS]
    missing = {f.split()[0]: F.lit(None).cast(f.split()[1]) for f in VERDICT.split(", ") if f.split()[0] not in records.columns}
    whole = records.withColumns(missing) if missing else records
    before = already_verified(F.col("verified"), F.col("verify_reason")) if resume else F.lit(False)
    done, todo = whole.where(before), whole.where(~before)
    rejected, survivors = tier_one(scored(todo, scorer), threshold, model)
    parts = [done, rejected]
    if cache is not None:
        hits, survivors = cached_verdicts(survivors, cache, model)
        parts.append(hits)
    parts.append(tier_two(survivors, judge, model, families))
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    return out


def kappa_strength(kappa: Column) -> Column:
    """The usual word for a kappa."""
    return (
        F.when(kappa < 0, "poor").when(kappa < 0.2, "slight").when(kappa < 0.4, "fair").when(kappa < 0.6, "moderate").when(kappa < 0.8, "substantial").otherwise("almost perfect")
    )
