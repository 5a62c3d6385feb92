"""Readers and writers of sentences, records, annotated corpora, pairs and vectors; any path that Spark reads will do."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

VARIANT = T.StructType(
    [
        T.StructField("base_id", T.StringType()),
        T.StructField("base_sentence", T.StringType()),
        T.StructField("variant", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("subtype", T.StringType()),
        T.StructField("cue_tokens", T.ArrayType(T.StringType())),
        T.StructField("cue_char_spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("net_negation", T.IntegerType()),
        T.StructField("generator", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("verified", T.BooleanType()),
    ]
)


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(ord, text): non-blank lines, trimmed, numbered in file order after blank ones are gone.

    Numbers come from counts by input split, not from a sort of all lines in one task.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("text"), F.spark_partition_id().alias("split"), F.monotonically_increasing_id().alias("seq")).where("text <> ''")
    counts = lines.groupBy("split").count()
    before = counts.select("split", (F.sum("count").over(W.orderBy("split")) - F.col("count")).alias("before"))  # a row per split
    nth = F.row_number().over(W.partitionBy("split").orderBy("seq"))
    return lines.withColumn("nth", nth).join(before, "split").select((F.col("before") + F.col("nth") - 1).alias("ord"), "text")


def read_records(spark: SparkSession, path: str, schema: T.StructType = VARIANT) -> DataFrame:
    """JSON lines of variant records; malformed lines are skipped, absent judgements stay null."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_records(records: DataFrame, path: str) -> None:
    """JSON lines, one file per partition; nulls are written, as an open judgement is one."""
    records.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_blind(items: DataFrame, blind: str, rest: str, shown: tuple[str, ...] = ("id", "a", "b")) -> None:
    """What raters may see to one place, all else to another."""
    items.select(*shown).write.mode("overwrite").json(blind)
    items.drop(*[c for c in shown if c != "id"]).write.mode("overwrite").json(rest)


def read_conll(spark: SparkSession, path: str, fixed: int = 7) -> DataFrame:
    """One row per negation instance of a corpus of tab columns with (cue, scope, event) triples after `fixed` columns.

    sentence_id, sentence, tokens, instance, cue_text, cue_idx, scope_idx; sentences without negation (***) give none.
    """
    blocks = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    rows = F.transform(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""), lambda x: F.split(x, "\t"))
    held = blocks.select(rows.alias("rows")).withColumn("first", F.element_at("rows", 1)).where(F.size("first") > fixed)
    held = held.where(F.element_at("first", fixed + 1) != "***").withColumn("n", F.floor((F.size("first") - fixed) / 3).cast("int"))
    each = held.select("rows", "first", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("instance"))

    def marked(place: int) -> Column:
        column = F.lit(fixed + place + 1) + 3 * F.col("instance")
        return F.array_compact(F.transform("rows", lambda r, i: F.when(F.try_element_at(r, column) != "_", i)))

    tokens = F.transform("rows", lambda r: F.element_at(r, 4))
    cue = F.transform(F.filter("rows", lambda r: F.try_element_at(r, F.lit(fixed + 1) + 3 * F.col("instance")) != "_"), lambda r: F.element_at(r, F.lit(fixed + 1) + 3 * F.col("instance")))
    return each.select(
        F.concat_ws(":", F.element_at("first", 1), F.element_at("first", 2)).alias("sentence_id"),
        F.array_join(tokens, " ").alias("sentence"),
        tokens.alias("tokens"),
        "instance",
        F.array_join(cue, " ").alias("cue_text"),
        marked(0).alias("cue_idx"),
        marked(1).alias("scope_idx"),
    ).where(F.size("cue_idx") > 0)


def index_spans(indices: Column) -> Column:
    """Half-open spans of runs of neighbouring indices."""
    starts = F.filter(indices, lambda i: ~F.array_contains(indices, i - 1))
    ends = F.filter(indices, lambda i: ~F.array_contains(indices, i + 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end")))


def _walk(node: ET.Element, owners: tuple[str, ...], out: list[tuple[str, list[str]]]) -> None:
    """Words of an element with the ids of the cues and scopes around them."""
    if node.tag in ("cue", "xcope"):
        owners = (*owners, f"{node.tag}:{node.get('ID') or node.get('id') or node.get('ref') or ''}")
    for word in (node.text or "").split():
        out.append((word, list(owners)))
    for child in node:
        _walk(child, owners, out)
        for word in (child.tail or "").split():
            out.append((word, list(owners)))


def read_inline_xml(spark: SparkSession, path: str, sentence_tag: str = "sentence") -> DataFrame:
    """(file, sentence_no, words array<struct<word, owners>>) of corpora with inline cue and scope elements.

    Ownership of nested elements has no column form, so each file is walked in Python; malformed files are skipped.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch.path, batch.content):
                try:
                    tree = ET.fromstring(content)
                except ET.ParseError:
                    continue
                found = [e for e in tree.iter() if e.tag.lower() == sentence_tag.lower()]
                for k, element in enumerate(found):
                    words: list[tuple[str, list[str]]] = []
                    _walk(element, (), words)
                    rows.append((name, k, [{"word": w, "owners": o} for w, o in words]))
            yield pd.DataFrame(rows, columns=["file", "sentence_no", "words"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, sentence_no int, words array<struct<word: string, owners: array<string>>>")


def cue_scopes(sentences: DataFrame) -> DataFrame:
    """(file, sentence_no, owner, idx): token indices of every cue and scope of read_inline_xml()."""
    tokens = sentences.select("file", "sentence_no", F.posexplode("words").alias("i", "w"))
    owned = tokens.select("file", "sentence_no", "i", F.explode("w.owners").alias("owner"))
    return owned.groupBy("file", "sentence_no", "owner").agg(F.sort_array(F.collect_list("i")).alias("idx"))  # words of one sentence


def read_pairs(spark: SparkSession, path: str, sep: str = "\t", encoding: str = "UTF-8") -> DataFrame:
    """Delimited sentence pairs with a header; quoted fields may hold line breaks."""
    return spark.read.csv(path, sep=sep, header=True, encoding=encoding, multiLine=True, escape='"')


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec array<float>) of a text file of words and numbers."""
    parts = F.split(F.trim("value"), " ")
    lines = spark.read.text(path).where(F.size(parts) > 2)  # a header line has two fields
    return lines.select(F.element_at(parts, 1).alias("word"), F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x.cast("float")).alias("vec"))


def redacted(lines: DataFrame, text: str, sample: int = 200) -> DataFrame:
    """One row: whether the first `sample` non-blank lines are all without letters and digits."""
    return lines.where(F.trim(text) != "").limit(sample).agg(F.coalesce(F.bool_and(~F.col(text).rlike(r"[\p{L}\p{N}]")), F.lit(False)).alias("redacted"))
