"""Sentence, token and morphology queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import lexicons, morphology, text
from tessera.plans.registry import query, words_in
from tessera.session import table

SENTENCES = r"""sentences AS (
    SELECT doc_id, lang, ord - 1 AS ord, sentence FROM (
        SELECT doc_id, lang, unnest(kept) AS sentence, generate_subscripts(kept, 1) AS ord FROM (
            SELECT doc_id, lang, list_filter(list_transform(regexp_split_to_array(text, '(?:[.!?]+\s+|\n+)'), lambda s: trim(s)), lambda s: s <> '') AS kept
            FROM documents)))"""
WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}'']+')"
PREFIXED = " OR ".join(f"(starts_with(w, '{p}') AND length(w) > {len(p) + 4})" for p in ("un", "non", "im", "ir", "il"))
# the words as SQL knows them, written out
_CUE_BASES = """not cannot no nt never hardly barely rarely seldom scarcely none neither nobody nothing nowhere nor noone no-one without devoid free absence impossible unlikely unable incapable
    unfit unclear invalid incorrect inaccurate inconsistent incomplete unavailable unsafe unstable unusual unhappy unfair irrelevant illegal illegible improbable imperfect insufficient unsuccessful
    unwilling unreliable unknown nonexistent dishonest useless hopeless harmless careless meaningless powerless worthless fruitless absent lacking void empty missing fail fails failed lack lacks
    lacked refuse refuses refused deny denies denied neglect neglects neglected cease ceases ceased"""
CUE = f"(regexp_matches(w, '^(?:{'|'.join(_CUE_BASES.split())})(?:s|es|ed|d|ing)?$') OR (ends_with(w, 'less') AND length(w) > 6) OR {PREFIXED})"
CUE_COUNT = (
    r"len(list_filter(regexp_split_to_array(array_to_string(list_transform(list_filter(regexp_split_to_array({}, '\s+'), lambda x: x <> ''), "
    + r"""lambda x: lower(replace(trim(x, '.,;:!?''"'), 'n''t', ' nt'))), ' '), '\s+'), lambda w: w <> '' AND """ + CUE.replace("{", "{{").replace("}", "}}") + "))"
)


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, ord, sentence) of all documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.posexplode(text.sentences(F.col("text"))).alias("ord", "sentence"))


@query("sentence_scan", f"WITH {SENTENCES} SELECT doc_id, ord, sentence FROM sentences")
def sentence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).select("doc_id", F.col("ord").cast("long").alias("ord"), "sentence")


@query(
    "sentence_base_id",
    f"WITH {SENTENCES} SELECT doc_id, ord, 's' || lpad(CAST(ord AS VARCHAR), 5, '0') || '_' || substr(sha1(sentence), 1, 10) AS base_id FROM sentences WHERE lang = 'en'",
)
def sentence_base_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities that hold the sentence's place and its digest."""
    found = sentences(spark, sf_dir).where("lang = 'en'")
    digest = F.substr(F.sha1(F.col("sentence").cast("binary")), F.lit(1), F.lit(10))
    return found.select("doc_id", F.col("ord").cast("long").alias("ord"), F.concat(F.lit("s"), F.lpad(F.col("ord").cast("string"), 5, "0"), F.lit("_"), digest).alias("base_id"))


@query("pair_key", r"SELECT conv_id, turn, rtrim(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), ' .') AS key FROM conversations")
def pair_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised key of every conversation turn."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.pair_key(F.col("text")).alias("key"))


@query(
    "dedup_key",
    r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(nfc_normalize(text)), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM documents",
)
def dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.dedup_key(F.col("text")).alias("key"))


@query(
    "token_set",
    "SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+'))) AS n_tokens, array_to_string(regexp_extract_all(lower(text), '[a-z0-9'']+'), ' ') AS norm FROM documents",
)
def token_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(text.token_set(F.col("text"))).cast("long").alias("n_tokens"), text.alnum_key(F.col("text")).alias("norm"))


@query("cue_count", f"WITH {SENTENCES} SELECT doc_id, ord, {CUE_COUNT.format('sentence')} AS n_cues FROM sentences WHERE lang = 'en'")
def cue_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical negation cues of every English sentence."""
    found = sentences(spark, sf_dir).where("lang = 'en'")
    return found.select("doc_id", F.col("ord").cast("long").alias("ord"), text.cue_count(F.col("sentence")).cast("long").alias("n_cues"))


@query(
    "one_sentence",
    rf"""WITH {SENTENCES} SELECT doc_id, ord, len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda w: w <> '')) BETWEEN 5 AND 40
        AND len(regexp_extract_all(sentence, '[.!?]+')) <= 1 AS single FROM sentences""",
)
def one_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).select("doc_id", F.col("ord").cast("long").alias("ord"), text.one_sentence(F.col("sentence")).alias("single"))


FAMILY = f"""CASE WHEN w IN ('not', 'n''t', 'cannot', 'cant') THEN 'syntactic'
    WHEN w IN ('no', 'none', 'nobody', 'no-one', 'noone', 'nothing', 'nowhere', 'neither', 'nor') THEN 'quantifier'
    WHEN w IN {words_in(list(lexicons.NEGATIVE_ADVERBS))} THEN 'neg_adverb' WHEN w = 'without' THEN 'prepositional'
    WHEN w IN ('fail', 'fails', 'failed', 'lack', 'lacks', 'lacked', 'refuse', 'refuses', 'refused', 'deny', 'denies', 'denied') THEN 'implicit'
    WHEN w IN {words_in(lexicons.LEXICALLY_NEGATIVE)} OR regexp_matches(w, '^(?:un|non|im|ir|il|in|dis).{{4,}}$') OR regexp_matches(w, '^.{{3,}}less$') THEN 'affixal' END"""


@query(
    "cue_family",
    f"""SELECT family, w AS cue, count(*) AS n FROM (SELECT w, {FAMILY} AS family FROM (SELECT unnest({WORDS.format('text')}) AS w FROM documents WHERE lang = 'en'))
        WHERE family IS NOT NULL GROUP BY ALL""",
)
def cue_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each cue word occurs in English documents, with its family."""
    found = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.explode(text.words(F.col("text"))).alias("cue"))
    # words first, families of the distinct ones after: the cascade runs once for each word form
    counted = found.groupBy("cue").agg(F.count("*").alias("n"))
    return counted.withColumn("family", text.cue_family(F.col("cue"))).where("family IS NOT NULL").select("family", "cue", "n")


@query(
    "cue_spans",
    f"""WITH {SENTENCES}, toks AS (SELECT doc_id, ord, sentence, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT *, regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}'']+') AS ws FROM sentences)),
        hits AS (SELECT doc_id, ord, i, i - row_number() OVER (PARTITION BY doc_id, ord ORDER BY i) AS island FROM toks WHERE w IN {words_in(lexicons.EXPLICIT_CUES)})
        SELECT doc_id, ord, min(i) - 1 AS span_start, max(i) AS span_end FROM hits GROUP BY doc_id, ord, island""",
)
def cue_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous half-open token spans of explicit cues: gaps and islands inside an array, without a shuffle."""
    # places of cues by one walk over the words; looking each place up would split the sentence again every time
    at = F.array_compact(F.transform(text.words(F.col("sentence")), lambda w, i: F.when(w.isin(lexicons.EXPLICIT_CUES), i + 1)))
    held = sentences(spark, sf_dir).select("doc_id", "ord", at.alias("at")).where(F.size("at") > 0)
    starts = F.filter("at", lambda i: ~F.array_contains("at", i - 1))
    ends = F.filter("at", lambda i: ~F.array_contains("at", i + 1))
    spans = held.select("doc_id", "ord", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("x"))
    return spans.select("doc_id", F.col("ord").cast("long").alias("ord"), (F.col("x.s") - 1).cast("long").alias("span_start"), F.col("x.e").cast("long").alias("span_end"))


@query(
    "spacing",
    r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), ' ([,.;:!?])', '\1', 'g')) AS text FROM documents",
)
def spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.spacing(F.col("text")).alias("text"))


_LEMMA = "(SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{3,}')) AS lemma FROM benchmark)"
_DOUBLE = "regexp_matches(lemma, '[^aeiou][aeiou][^aeiouwxy]$')"
_PAST = f"""CASE WHEN regexp_matches(lemma, 'e$') THEN lemma || 'd' WHEN regexp_matches(lemma, '[^aeiou]y$') THEN regexp_replace(lemma, 'y$', 'ied')
    WHEN {_DOUBLE} THEN lemma || right(lemma, 1) || 'ed' ELSE lemma || 'ed' END"""
_IRREGULAR = ", ".join(str(row) for row in lexicons.IRREGULAR_VERBS)


@query(
    "verb_forms",
    f"""SELECT lemma,
        CASE WHEN lemma = 'be' THEN 'is' WHEN lemma = 'have' THEN 'has' WHEN regexp_matches(lemma, '[^aeiou]y$') THEN regexp_replace(lemma, 'y$', 'ies')
            WHEN regexp_matches(lemma, '(?:s|x|z|ch|sh|o)$') THEN lemma || 'es' ELSE lemma || 's' END AS vbz,
        coalesce(irregular.past, {_PAST}) AS vbd, coalesce(irregular.participle, {_PAST}) AS vbn,
        CASE WHEN regexp_matches(lemma, 'ie$') THEN regexp_replace(lemma, 'ie$', 'ying') WHEN regexp_matches(lemma, '[^eoy]e$') THEN regexp_replace(lemma, 'e$', 'ing')
            WHEN {_DOUBLE} THEN lemma || right(lemma, 1) || 'ing' ELSE lemma || 'ing' END AS vbg
        FROM {_LEMMA} LEFT JOIN (VALUES {_IRREGULAR}) AS irregular(verb, past, participle) ON lemma = verb""",
)
def verb_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inflected forms of every word of the benchmark, taken as a verb."""
    lemmas = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{3,}"), F.lit(0))).alias("lemma")).distinct()
    c = F.col("lemma")
    return lemmas.select("lemma", morphology.third_person(c).alias("vbz"), morphology.past(c).alias("vbd"), morphology.past_participle(c).alias("vbn"), morphology.present_participle(c).alias("vbg"))


@query(
    "affixal_strip",
    f"""WITH words AS (SELECT DISTINCT unnest({WORDS.format('text')}) AS w FROM documents WHERE lang = 'en'),
        made AS (SELECT w AS stem, p || w AS derived FROM words, (VALUES ('un', ''), ('in', ''), ('im', 'bmp'), ('ir', 'r'), ('il', 'l'), ('non', ''), ('dis', '')) AS prefixes(p, onset)
            WHERE onset = '' OR contains(onset, left(w, 1)))
        SELECT stem, derived FROM made WHERE length(stem) >= 3 AND derived IN (SELECT w FROM words)""",
)
def affixal_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word forms whose negative derivation is also a word of the corpus: candidates, then a semi join."""
    words = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.explode(text.words(F.col("text"))).alias("stem")).distinct()
    options = []
    for p in lexicons.NEGATIVE_PREFIXES:
        onset = lexicons.PREFIX_ONSETS.get(p, "")
        fits = F.lit(True) if not onset else F.substr("stem", F.lit(1), F.lit(1)).isin(list(onset))
        options.append(F.when(fits, F.concat(F.lit(p), "stem")))
    made = words.where(F.length("stem") >= 3).select("stem", F.explode(F.array_compact(F.array(*options))).alias("derived"))
    return made.join(words.withColumnRenamed("stem", "derived"), "derived", "left_semi").select("stem", "derived")


@query(
    "quantifier_swap",
    f"""WITH {SENTENCES}, toks AS (SELECT doc_id, ord, ws, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT *, string_split(sentence, ' ') AS ws FROM sentences WHERE lang = 'en'))
        SELECT doc_id, ord, i - 1 AS place, array_to_string(list_concat(list_concat(ws[1:i-1], [swapped]), ws[i+1:]), ' ') AS variant
        FROM toks JOIN (VALUES {", ".join(str(x) for x in lexicons.QUANTIFIER_SWAPS.items())}) AS swaps(q, swapped) ON lower(w) = q""",
)
def quantifier_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variant for every quantifier word of a sentence, by its negative counterpart."""
    swaps = F.create_map(*[F.lit(x) for item in lexicons.QUANTIFIER_SWAPS.items() for x in item])
    found = sentences(spark, sf_dir).where("lang = 'en'").withColumn("ws", F.split("sentence", " "))
    toks = found.select("doc_id", "ord", "ws", F.posexplode("ws").alias("place", "w")).where(F.lower("w").isin(list(lexicons.QUANTIFIER_SWAPS)))
    parts = F.concat(F.slice("ws", F.lit(1), F.col("place")), F.array(F.element_at(swaps, F.lower("w"))), F.slice("ws", F.col("place") + 2, F.size("ws")))
    return toks.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("place").cast("long").alias("place"), F.array_join(parts, " ").alias("variant"))
