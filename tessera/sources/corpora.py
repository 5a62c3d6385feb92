"""Annotated corpora as one table of annotation instances, whatever their format.

An instance is (sentence, tokens, cue_spans, scope_spans, cue_family, source_dataset, split, sentence_id, annotation_type,
cue_text, provenance, extra); spans are half-open token spans, and a scope may have several.
"""

from __future__ import annotations

import functools
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tessera.functions import cues as C
from tessera.sources.readers import index_spans, read_conll, read_pairs

SPANS = "array<struct<start:int,end:int>>"
INSTANCE = [
    "sentence", "tokens", "cue_spans", "scope_spans", "cue_family", "source_dataset", "split", "sentence_id", "annotation_type", "cue_text", "provenance", "extra",
]
GOLD, PAIR_ONLY = "gold-span", "pair-level-only"


def _walked(sentence: ET.Element) -> tuple[list[tuple[str, list[str]]], list[dict]]:
    """The words of a sentence with the elements around each, and its cues with the scope that each names.

    A scope names its cue by a ref element inside it, or the cue names its scope by an attribute.
    """
    words: list[tuple[str, list[str]]] = []
    cues: list[dict] = []
    named = {ref.get("SRC"): f"scope:{x.get('ID')}" for x in sentence.iter("xcope") for ref in x.iter("ref") if ref.get("SRC") is not None}

    def walk(node: ET.Element, around: tuple[str, ...]) -> None:
        if node.tag == "xcope":
            around = (*around, f"scope:{node.get('ID') or node.get('id')}")
        elif node.tag == "cue":
            key = f"cue:{len(cues)}"
            scope = f"scope:{node.get('ref')}" if node.get("ref") is not None else named.get(node.get("ID"), "")
            cues.append({"key": key, "type": (node.get("type") or "").lower(), "scope": scope})
            around = (*around, key)
        words.extend((w, list(around)) for w in (node.text or "").split())
        for child in node:
            walk(child, around)
            words.extend((w, list(around)) for w in (child.tail or "").split())

    walk(sentence, ())
    return words, cues


def read_annotated_xml(spark: SparkSession, path: str, dataset: str, sentence_tag: str = "sentence", split: str = "all", types: tuple[str, ...] = ("negation", "speculation")) -> DataFrame:
    """Instances of a corpus of XML files with cue and xcope elements; a scope is without its cue's tokens.

    Files that are no XML are skipped; sentences without words and cues without tokens give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.path, batch.content):
                try:
                    tree = ET.fromstring(content)
                except ET.ParseError:
                    continue
                for k, element in enumerate(e for e in tree.iter() if e.tag.lower() == sentence_tag.lower()):
                    words, cues = _walked(element)
                    if words:
                        rows.append((name, element.get("id") or str(k), [w for w, _ in words], [o for _, o in words], cues))
            yield pd.DataFrame(rows, columns=["file", "number", "tokens", "owners", "cues"])

    shape = "file string, number string, tokens array<string>, owners array<array<string>>, cues array<struct<key:string,type:string,scope:string>>"
    held = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, shape)
    each = held.withColumn("c", F.explode("cues")).where(F.col("c.type").isin(*types))
    owned = lambda key: F.array_compact(F.transform("owners", lambda o, i: F.when(F.array_contains(o, key), i)))
    each = each.withColumn("cue_idx", owned(F.col("c.key"))).where(F.size("cue_idx") > 0).withColumn("scope_idx", F.array_except(owned(F.col("c.scope")), "cue_idx"))
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    folder = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    extra = F.create_map(F.lit("category"), folder, F.lit("document"), stem)
    return _instances(each, dataset, F.lit(split), F.concat_ws(":", F.lit(dataset.lower()), folder, stem, "number"), F.col("c.type"), extra)


def _instances(held: DataFrame, dataset: str, split: Column, sentence_id: Column, annotation: Column, extra: Column) -> DataFrame:
    """Instances of rows with tokens, cue_idx and scope_idx."""
    words = F.transform("cue_idx", lambda i: F.get("tokens", i))
    text = F.array_join(words, " ")
    family = C.family(text, F.get(words, 0), annotation)
    made = {
        "sentence": F.array_join("tokens", " "), "tokens": F.col("tokens"), "cue_spans": index_spans(F.col("cue_idx")).cast(SPANS), "scope_spans": index_spans(F.col("scope_idx")).cast(SPANS),
        "cue_family": C.scope_position(family, F.col("tokens"), F.col("cue_idx")), "source_dataset": F.lit(dataset), "split": split, "sentence_id": sentence_id, "annotation_type": annotation,
        "cue_text": text, "provenance": F.lit(GOLD), "extra": extra,
    }
    return held.select(*[c.alias(n) for n, c in made.items()])


def read_conll_instances(spark: SparkSession, path: str, dataset: str, split: str) -> DataFrame:
    """Instances of a corpus of tab columns with triples."""
    held = read_conll(spark, path).withColumn("no", F.col("instance").cast("string"))
    return _instances(held, dataset, F.lit(split), F.concat_ws(":", F.lit(dataset.lower()), "sentence_id"), F.lit("negation"), F.create_map(F.lit("instance"), F.col("no")))


def pair_instances(pairs: DataFrame, text_col: str, dataset: str, split: str, prefix: str, extra: dict[str, str]) -> DataFrame:
    """Instances of sentence pairs: the hypothesis without spans, for whole-pair labels. extra maps names to columns; blank
    hypotheses are left out, but count in the numbers of the others."""
    pairs = _numbered(pairs).withColumn(text_col, F.trim(F.coalesce(text_col, F.lit("")))).where(F.col(text_col) != "")
    named = F.create_map(*[x for name, column in extra.items() for x in (F.lit(name), F.trim(F.col(f"`{column}`").cast("string")))])
    empty = F.array().cast(SPANS)
    made = {
        "sentence": F.col(text_col), "tokens": F.filter(F.split(F.trim(text_col), r"\s+"), lambda w: w != ""), "cue_spans": empty, "scope_spans": empty, "cue_family": F.lit(C.UNMAPPED),
        "source_dataset": F.lit(dataset), "split": F.lit(split), "sentence_id": F.concat_ws(":", F.lit(prefix), F.col("_row").cast("string")), "annotation_type": F.lit("negation"),
        "cue_text": F.lit(""), "provenance": F.lit(PAIR_ONLY), "extra": named,
    }
    return pairs.select(*[c.alias(n) for n, c in made.items()])


def _numbered(pairs: DataFrame) -> DataFrame:
    """Adds a row number in file order: from counts by split, so that no task sorts all rows."""
    marked = pairs.withColumns({"_split": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()})
    counts = marked.groupBy("_split").agg(F.count("*").alias("_n"))
    before = counts.select("_split", (F.sum("_n").over(W.orderBy("_split")) - F.col("_n")).alias("_before"))  # one row per split
    nth = F.row_number().over(W.partitionBy("_split").orderBy("_seq"))
    return marked.withColumn("_nth", nth).join(F.broadcast(before), "_split").withColumn("_row", F.col("_before") + F.col("_nth") - 1).drop("_split", "_seq", "_nth", "_before")


def read_cannot(spark: SparkSession, path: str, split: str = "all") -> DataFrame:
    """Instances of a tab-separated table of premise, hypothesis, label."""
    return pair_instances(read_pairs(spark, path), "hypothesis", "CANNOT", split, "cannot", {"premise": "premise", "label": "label"})


def read_negnli(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Instances of several Latin-1 tables (name -> path) of Text, Hypothesis, gold_label, one after the other."""
    parts = [pair_instances(read_pairs(spark, p, encoding="ISO-8859-1"), "Hypothesis", "NegNLI", n, f"negnli:{n}", {"premise": "Text", "label": "gold_label"}) for n, p in paths.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def read_nan_nli(spark: SparkSession, path: str, split: str = "test") -> DataFrame:
    """Instances of a comma-separated table that also names the construction of the negation."""
    extra = {"premise": "premise", "label": "label", "construction": "Construction", "construction_subtype": "Construction Subtype"}
    return pair_instances(read_pairs(spark, path, sep=","), "hypothesis", "NaN-NLI", split, "nannli", extra)


def read_scored_pairs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(a, b, label string, score double) of a Parquet table (sentence1, sentence2, score) or of JSON lines, also gzipped
    (sentence1, sentence2, gold_label); rows without both sentences go."""
    rows = spark.read.parquet(path) if kind == "parquet" else spark.read.json(path)
    has = lambda c, t: F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t)
    return rows.select(F.col("sentence1").alias("a"), F.col("sentence2").alias("b"), has("gold_label", "string").alias("label"), has("score", "double").alias("score")).where("a IS NOT NULL AND b IS NOT NULL")


def read_dev(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of a cleaned development table, with label as a number, split dev and their kind."""
    rows = read_pairs(spark, path, sep=",")
    human = (F.col("subtype") == "paraphrase") & (F.col("source") == "antonym-substitution")
    return rows.withColumns({
        "label": F.col("label").cast("int"), "neg_type": F.nullif("neg_type", F.lit("")), "split": F.lit("dev"), "kind": F.when(human, "SemAntoNeg").otherwise(F.col("subtype")),
    })


def read_paraphrases(spark: SparkSession, path: str) -> DataFrame:
    """(base_line int, method, text, note) of reviewed paraphrases: rows kept by their reviewers, without comment lines."""
    rows = spark.read.csv(path, sep="\t", header=True, comment="#")
    return rows.where(F.trim("keep") == "1").select(F.col("base_line").cast("int").alias("base_line"), "method", "text", "note")


def write_features(rows: DataFrame, path: str, names: list[str], labels: list[str]) -> None:
    """A feature table with a header: label columns, then the array `features` as columns of the names, 5 places each."""
    columns = [F.round(F.get("features", k), 5).alias(n) for k, n in enumerate(names)]
    rows.select(*labels, *columns).write.mode("overwrite").option("header", True).csv(path)


def limited_vectors(vectors: DataFrame, most: int | None = None, only: DataFrame | None = None, order: str = "ord") -> DataFrame:
    """Vectors of a vocabulary: the first `most` by file order, or those of the words of `only`."""
    held = vectors if only is None else vectors.join(only.select("word").distinct(), "word", "left_semi")
    return held if most is None else held.orderBy(order).limit(most)


# Corpora that the readers know, with their kind of annotation.
CATALOGUE = [
    ("CD-SCO", "conll", "negation", "cue and scope spans"), ("SFU", "xml", "negation, speculation", "cue and scope spans"), ("BioScope", "xml", "negation, speculation", "cue and scope spans"),
    ("CANNOT", "tsv", "negation", "pairs"), ("NegNLI", "tsv", "negation", "pairs"), ("NaN-NLI", "csv", "negation", "pairs"),
]


def catalogue(spark: SparkSession) -> DataFrame:
    """(corpus, format, annotation, level) of the corpora that the readers know."""
    return spark.createDataFrame(CATALOGUE, "corpus string, format string, annotation string, level string")
