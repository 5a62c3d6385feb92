"""Parsed sentences: readers of trees, and the one place where a parser is asked.

A parsed sentence is (sent_id, text, tok), tok an array of parsed.TOKEN. Trees come from CoNLL-U files, from a parser
given by the caller, or from spaCy where it is installed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.functions.parsed import TOKEN

SHAPE = f"sent_id string, text string, tok array<{TOKEN}>"
Token = tuple[str, str, str, str, str, int, dict[str, str]]  # text, lemma, part of speech, tag, role, head (0-based), features
Parser = Callable[[list[str]], list[list[Token]]]
#: Sentences given to a parser at once.
BATCH = 256
# Words that count as stop words by their part of speech or tag.
CLOSED = ("DET", "ADP", "PRON", "AUX", "CCONJ", "SCONJ", "PART")


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """(sent_id, text, tok) of CoNLL-U files: ten columns, heads from 1, 0 for a root; words of several tokens are skipped.

    sent_id and text are read from their comments; a sentence without a text comment has its forms joined by blanks, less
    those marked SpaceAfter=No. Blank sentences are dropped.
    """
    raw = spark.read.text(path, lineSep="\n\n").withColumn("lines", F.split("value", r"\r?\n"))
    comment = lambda name: F.regexp_extract("value", rf"(?m)^# {name} = (.*?)\s*$", 1)
    rows = F.transform(F.filter("lines", lambda x: x.rlike(r"^\d+\t")), lambda x: F.split(x, "\t"))
    glued = lambda r: F.get(r, 9).contains("SpaceAfter=No")
    forms = F.array_join(F.transform(rows, lambda r: F.concat(F.get(r, 1), F.when(glued(r), "").otherwise(" "))), "")
    held = raw.select(comment("sent_id").alias("sent_id"), F.coalesce(F.nullif(comment("text"), F.lit("")), F.trim(forms)).alias("text"), rows.alias("rows")).where(F.size("rows") > 0)
    return held.select("sent_id", "text", _tokens(F.col("text"), F.col("rows")).alias("tok"))


def _tokens(text: Column, rows: Column) -> Column:
    """The tokens of CoNLL-U rows, each found in the text behind the one before."""
    found = lambda done, r: F.call_function("locate", F.get(r, 1), text, done["pos"])
    offsets = F.aggregate(
        rows,
        F.struct(F.lit(1).alias("pos"), F.array().cast("array<int>").alias("at")),
        lambda done, r: F.struct((found(done, r) + F.length(F.get(r, 1))).alias("pos"), F.concat(done["at"], F.array(found(done, r) - 1)).alias("at")),
        lambda done: done["at"],
    )

    def made(r: Column, k: Column) -> Column:
        feature = lambda name: F.nullif(F.regexp_extract(F.get(r, 5), rf"(?:^|\|){name}=([^|]*)", 1), F.lit(""))
        form, pos, head = F.get(r, 1), F.get(r, 3), F.get(r, 6).cast("int")
        columns = {
            "i": k, "idx": F.get(offsets, k), "text": form, "lower": F.lower(form), "lemma": F.get(r, 2), "pos": pos, "tag": F.get(r, 4), "dep": F.when(head == 0, "ROOT").otherwise(F.get(r, 7)),
            "head": F.when(head == 0, k).otherwise(head - 1), "tense": feature("Tense"), "person": feature("Person"), "number": feature("Number"),
            "is_alpha": form.rlike(r"^\p{L}+$"), "is_punct": pos == "PUNCT", "is_stop": pos.isin(*CLOSED),
        }
        return F.struct(*[c.alias(n) for n, c in columns.items()])

    return F.transform(rows, made).cast(f"array<{TOKEN}>")


def token_rows(text: str, tokens: list[Token]) -> list[dict]:
    """A parser's tokens as rows, with their offsets in the text."""
    out, at = [], 0
    for i, (form, lemma, pos, tag, dep, head, features) in enumerate(tokens):
        at = text.index(form, at)
        out.append({
            "i": i, "idx": at, "text": form, "lower": form.lower(), "lemma": lemma, "pos": pos, "tag": tag, "dep": dep, "head": head,
            "tense": features.get("Tense"), "person": features.get("Person"), "number": features.get("Number"),
            "is_alpha": form.isalpha(), "is_punct": pos == "PUNCT", "is_stop": pos in CLOSED,
        })
        at += len(form)
    return out


def spacy_parser(model: str = "en_core_web_sm") -> Parser:
    """A parser of spaCy's; an ImportError says that it is not installed."""
    held: list = []

    def run(texts: list[str]) -> list[list[Token]]:
        import spacy

        if not held:
            held.append(spacy.load(model))
        return [[(t.text, t.lemma_, t.pos_, t.tag_, t.dep_, t.head.i, t.morph.to_dict()) for t in doc] for doc in held[0].pipe(texts, batch_size=BATCH)]

    return run


def parse_sentences(sentences: DataFrame, parser: Parser, id_col: str = "sent_id", text_col: str = "text") -> DataFrame:
    """(sent_id, text, tok) of every sentence that is not blank; `parser` gets BATCH texts at a time on the executors.

    Every distinct text is best parsed once: distinct the sentences before and join after where they repeat.
    """
    rows = sentences.select(F.col(id_col).cast("string").alias("sent_id"), F.trim(F.col(text_col)).alias("text")).where("text <> ''")
    shape = sentences.sparkSession.createDataFrame([], SHAPE).schema
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH):
                part = batch.slice(first, BATCH)
                texts = part.column(1).to_pylist()
                tok = [token_rows(t, found) for t, found in zip(texts, parser(texts))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(tok, arrow.field("tok").type)], names=["sent_id", "text", "tok"])

    return rows.mapInArrow(run, shape)


# a short notation, for trees that are written by hand

# Tag -> (part of speech, features).
TAGS = {
    "DT": ("DET", {}), "PDT": ("DET", {}), "WDT": ("DET", {}), "NN": ("NOUN", {"Number": "Sing"}), "NNS": ("NOUN", {"Number": "Plur"}), "NNP": ("PROPN", {"Number": "Sing"}),
    "PRP": ("PRON", {}), "WP": ("PRON", {}), "EX": ("PRON", {}), "WRB": ("ADV", {}), "RB": ("ADV", {}), "RBR": ("ADV", {}), "JJ": ("ADJ", {}), "JJR": ("ADJ", {}), "JJS": ("ADJ", {}),
    "IN": ("ADP", {}), "TO": ("PART", {}), "CC": ("CCONJ", {}), "CD": ("NUM", {}), "MD": ("AUX", {}), "VB": ("VERB", {}), "VBG": ("VERB", {"Tense": "Pres"}), "VBN": ("VERB", {"Tense": "Past"}),
    "VBZ": ("VERB", {"Tense": "Pres", "Person": "3", "Number": "Sing"}), "VBP": ("VERB", {"Tense": "Pres"}), "VBD": ("VERB", {"Tense": "Past"}), ".": ("PUNCT", {}), ",": ("PUNCT", {}), ":": ("PUNCT", {}), "HYPH": ("PUNCT", {}),
}
NOTED = re.compile(r"(~?)([^\s=_]+)(?:=([^\s_]+))?_([^\s_]+)_([^\s_]+)_(\d+)")


def noted(notation: str) -> tuple[str, list[Token]]:
    """(text, tokens) of a tree in short: form=lemma_TAG_role_head for each token, heads from 1, ~ before what stands close.

    The lemma may be left out where it is the form in lower case. Auxiliaries and forms of be are AUX, negators PART,
    markers SCONJ; other parts of speech and features follow from the tag.
    """
    text, out = "", []
    for close, form, lemma, tag, dep, head in NOTED.findall(notation):
        text += ("" if close or not text else " ") + form
        pos, features = TAGS[tag]
        lemma = lemma or form.lower()
        pos = "AUX" if dep in ("aux", "auxpass") and tag != "TO" or (lemma == "be" and pos == "VERB") else "PART" if dep == "neg" else "SCONJ" if dep == "mark" else pos
        if tag == "PRP":
            features = {"Number": "Plur" if form.lower() in ("we", "they", "us", "them") else "Sing", "Person": "1" if form.lower() in ("i", "we") else "2" if form.lower() == "you" else "3"}
        out.append((form, lemma, pos, tag, dep, int(head) - 1, features))
    return text, out


def noted_sentences(spark: SparkSession, notations: list[str]) -> DataFrame:
    """(sent_id, text, tok) of trees in the short notation, numbered from 0."""
    rows = [(str(n), text, token_rows(text, tokens)) for n, (text, tokens) in enumerate(map(noted, notations))]
    return spark.createDataFrame(rows, SHAPE)
