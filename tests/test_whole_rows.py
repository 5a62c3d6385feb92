"""Queries that hold whole texts and all rows."""

import re

import duckdb

from tessera.plans import catalogue


def _distance(a, b):
    x, y = (re.findall(r"[a-z0-9']+", s.lower()) for s in (a, b))
    row = list(range(len(y) + 1))
    for i, w in enumerate(x, 1):
        above, row[0] = row[0], i
        for j, v in enumerate(y, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (w != v))
    return row[-1]


def test_edit_distance_of_whole_turns(spark, tmp_path):
    turns = ["It is so. I agree with you!", "It is so. We don't agree\nat all", "\nA blank line first? Yes.", "", "One. Two. Three.", "Three. Two. One."]
    rows = [(1, i, "user", t) for i, t in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.turn: r.distance for r in catalogue.QUERIES["word_edit_distance"](spark, str(tmp_path)).collect()}
    assert found == {i: _distance(turns[i], turns[i + 1]) for i in range(len(turns) - 1)}


def test_every_document_has_a_donor(spark, tmp_path):
    sources = ["a"] * 20 + ["b"] * 3 + ["c"] * 7 + [None] * 2
    spark.createDataFrame(list(enumerate(sources)), "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.QUERIES["cross_topic_donors"](spark, str(tmp_path)).collect()
    following = {"a": "b", "b": "c", "c": None, None: "a"}
    assert sorted(r.base for r in found) == list(range(len(sources)))
    assert all(sources[r.donor] == following[sources[r.base]] for r in found)


def test_components_of_shared_sentences(spark, tmp_path):
    start = "This beginning is longer than forty characters in all documents"
    texts = [f"{start} one. A b c.", "A  B C. D e f!", "G h i. d e f!", f"{start} two. J k l.", "", None, "M n o. Nobody shares it."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.node: r.component for r in catalogue.QUERIES["components"](spark, str(tmp_path)).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6}
    sides = {r.doc_id: r.part for r in catalogue.QUERIES["component_split"](spark, str(tmp_path)).collect()}
    assert len(sides) == len(texts) and len({sides[i] for i in (0, 1, 2)}) == 1


SPACED = [
    "0 of 10 began. 1 came first, at 1! 22 were left at 2",
    "\u00a0 No-break\u00a0. \u3000wide\u3000! \u2009? thin\u2009",
    "A tab\tin it.\x0bNo break at a vertical tab. \x0b",
    "\n\n  One.  Two?!\r\nThree...\fFour \n",
    "...", " ", "", None,
]


def _beside_sql(spark, folder, name, rows):
    """Rows of a query and of its SQL over documents (doc_id, lang, text)."""
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    ours = catalogue.QUERIES[name](spark, str(folder))
    theirs = con.sql(f"SELECT {', '.join(ours.columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    return sorted(map(tuple, ours.collect()), key=str), sorted(theirs, key=str)


def test_first_wins_dedup_of_odd_texts(spark, tmp_path):
    texts = ["Version 2.0. Version 2. Version 2.", "ﬁne. fine. ﬁne", "x². x2. X²", "été. été. ÉTÉ", "ΟΔΟΣ. οδοσ. οδος", "İz. iz", "... . ?", "日本、語. 日本 語"]
    ours, theirs = _beside_sql(spark, tmp_path, "first_wins_dedup", [(i, lang, t) for lang in ("en", None) for i, t in enumerate([*texts, *SPACED])])
    assert ours == theirs


def test_base_ids_of_odd_texts(spark, tmp_path):
    rows = [(i, "en", t) for i, t in enumerate([*SPACED, "a. " * 100_002])] + [(100, "de", "Nein."), (101, None, "0 and 1.")]
    ours, theirs = _beside_sql(spark, tmp_path, "sentence_base_id", rows)
    assert ours == theirs and len(ours) > 100_002


def test_sentences_of_odd_texts(spark, tmp_path):
    ours, theirs = _beside_sql(spark, tmp_path, "sentence_scan", list(zip(range(len(SPACED)), ["en", None] * 4, SPACED)))
    assert ours == theirs
    assert [s for d, _, s in ours if d == 0] == ["0 of 10 began", "1 came first, at 1", "22 were left at 2"]
