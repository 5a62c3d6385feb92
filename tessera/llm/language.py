"""Language identification of mixed-language texts by script ranges and Viterbi over words.

A word's script narrows the languages to those that were learned with it. Within them a word scores by hashed
character 2- and 3-grams, and Viterbi with a switching penalty labels the words, so that a text falls into spans
of one language each. All texts of a batch step through Viterbi at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tessera.llm._common import as_text, ranges, runs

GRAMS = 1 << 15
#: Documents learned from at most, of each language.
SAMPLE = 1500
#: Log-probability that a change of language costs.
SWITCH = 10.0
UNKNOWN = "und"
#: Least share of letters of a document that is kept as one of a language.
LEAST_SHARE = 0.4
#: Words scored and kept at most by a worker; then it forgets them.
KEPT_WORDS = 1 << 17
GROUP = 1 << 22
#: A letter, and what letters and marks follow it.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
# First and last code points of script ranges; ranges of one number belong together.
SCRIPT_RANGES = [
    (0x0041, 0x024F, 1), (0x1E00, 0x1EFF, 1), (0x2C60, 0x2C7F, 1), (0xA720, 0xA7FF, 1), (0xFB00, 0xFB06, 1), (0xFF21, 0xFF5A, 1),  # Latin
    (0x0370, 0x03FF, 2), (0x1F00, 0x1FFF, 2),  # Greek
    (0x0400, 0x052F, 3), (0x1C80, 0x1C8F, 3), (0x2DE0, 0x2DFF, 3), (0xA640, 0xA69F, 3),  # Cyrillic
    (0x0531, 0x058F, 4),  # Armenian
    (0x0591, 0x05FF, 5), (0xFB1D, 0xFB4F, 5),  # Hebrew
    (0x0600, 0x06FF, 6), (0x0750, 0x077F, 6), (0x08A0, 0x08FF, 6), (0xFB50, 0xFDFF, 6), (0xFE70, 0xFEFF, 6),  # Arabic
    (0x0900, 0x097F, 7), (0x0980, 0x09FF, 8), (0x0A00, 0x0A7F, 9), (0x0B80, 0x0BFF, 10), (0x0C00, 0x0C7F, 11),  # Indic scripts
    (0x0E00, 0x0E7F, 12), (0x10A0, 0x10FF, 13), (0x1200, 0x139F, 14),  # Thai, Georgian, Ethiopic
    (0x1100, 0x11FF, 15), (0x3130, 0x318F, 15), (0xAC00, 0xD7FF, 15),  # Hangul
    (0x3040, 0x30FF, 16), (0x31F0, 0x31FF, 16), (0xFF66, 0xFF9F, 16),  # Kana
    (0x3400, 0x4DBF, 17), (0x4E00, 0x9FFF, 17), (0xF900, 0xFAFF, 17), (0x20000, 0x3FFFF, 17),  # Han
]
_FIRST = np.array([r[0] for r in sorted(SCRIPT_RANGES)])
_LAST = np.array([r[1] for r in sorted(SCRIPT_RANGES)])
_KIND = np.array([r[2] for r in sorted(SCRIPT_RANGES)])
N_SCRIPTS = int(_KIND.max()) + 1


def script_of(codes: np.ndarray) -> np.ndarray:
    """The script number of each code point; 0 where no range holds it."""
    at = np.maximum(np.searchsorted(_FIRST, codes, side="right") - 1, 0)
    return np.where((codes >= _FIRST[at]) & (codes <= _LAST[at]), _KIND[at], 0)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 2- and 3-grams of the words between blanks, the number of each word's, and each word's script."""
    padded = " " + " ".join(words) + " "
    codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    sizes = np.array([len(w) for w in words])
    firsts = np.cumsum(sizes + 1) - sizes  # place of each word's first character
    with np.errstate(over="ignore"):
        two = (codes[:-1] * 2654435761 + codes[1:] * 40503) % 4294967291
        three = (codes[:-2] * 2246822519 + codes[1:-1] * 3266489917 + codes[2:] * 668265263) % 4294967291
    two, three = two % GRAMS, three % GRAMS
    # n + 1 pairs and n triples of a word of n characters with its blanks
    a, b = two[ranges(firsts - 1, sizes + 1)], three[ranges(firsts - 1, sizes)]
    word = np.concatenate([np.repeat(np.arange(len(words)), sizes + 1), np.repeat(np.arange(len(words)), sizes)])
    order = np.argsort(word, kind="stable")
    return np.concatenate([a, b])[order], 2 * sizes + 1, script_of(codes[firsts])


class Model:
    """Log-probabilities by gram and language, the languages' scripts."""

    def __init__(self, langs: list[str], table: np.ndarray, scripts: np.ndarray):
        self.langs, self.table, self.scripts = langs, table, scripts  # scripts[script, language]
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.score = np.zeros((0, len(self.langs)), np.float32)

    def __getstate__(self):
        return self.langs, self.table, self.scripts

    def __setstate__(self, state):
        self.__init__(*state)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word by language; languages not learned with its script are far behind."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        for first, last in runs([len(w) + 1 for w in words], 1 << 18):
            grams, counts, scripts = _grams(words[first:last])
            sums = np.add.reduceat(self.table[grams], np.cumsum(counts) - counts, axis=0)
            fits = self.scripts[scripts]
            out[first:last] = sums - np.where(fits | ~fits.any(1, keepdims=True), 0, 1000)
        return out

    def numbered(self, texts: list[list[str]]) -> list[int]:
        """Rows of self.score for all words, one text after the other."""
        if len(self.number) > KEPT_WORDS:
            self._forget()
        number = self.number
        known = len(number)
        out = [number.setdefault(w, len(number)) for words in texts for w in words]
        if len(number) > known:
            new = list(number)[known:]
            self.score = np.concatenate([self.score, self.scores(new)])
        return out


def learn(rows: pd.DataFrame) -> Model:
    """A model from texts and their languages (columns text, lang)."""
    langs = sorted(rows.lang.unique())
    counts = np.zeros((GRAMS, len(langs)))
    seen = np.zeros((N_SCRIPTS, len(langs)))
    for i, lang in enumerate(langs):
        for text in rows.text[rows.lang == lang]:
            if words := WORD.findall(text.lower()):
                grams, _, scripts = _grams(words)
                counts[:, i] += np.bincount(grams, minlength=GRAMS)
                seen[:, i] += np.bincount(scripts, minlength=N_SCRIPTS)
    table = np.log((counts + 0.1) / (counts.sum(0) + 0.1 * GRAMS)).astype(np.float32)
    return Model(langs, table, seen > 0.01 * np.maximum(seen.sum(0), 1))


def label_words(scores: np.ndarray, index: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """Viterbi labels of all words, text after text; index picks each word's row of scores."""
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    long = counts[order]
    live = np.searchsorted(-long, -np.arange(1, (long[0] if len(long) else 0) + 1), side="right")
    n_langs = scores.shape[1]
    value = np.zeros((len(counts), n_langs), np.float32)
    back = np.zeros((len(index), n_langs), np.int8 if n_langs < 128 else np.int32)
    own = np.arange(n_langs)
    for k, n in enumerate(live):
        at = first[:n] + k
        now = value[:n]
        best = now.argmax(1)
        top = now[np.arange(n), best] - switch
        stay = now >= top[:, None]
        if k:
            back[at] = np.where(stay, own, best[:, None])
            now = np.where(stay, now, top[:, None])
        value[:n] = now + scores[index[at]]
    labels = np.zeros(len(index), np.int64)
    state = value.argmax(1)
    for k in range(len(live) - 1, -1, -1):
        n = live[k]
        at = first[:n] + k
        labels[at] = state[:n]
        if k:
            state[:n] = back[at, state[:n]]
    return labels


def predict(texts: list[str], model: Model, switch: float = SWITCH) -> list[tuple[str, float]]:
    """(language, score) of each text: the language of most letters and its share of them; ('und', 0) without letters."""
    out: list[tuple[str, float]] = []
    for begin, end in runs([len(t) for t in texts], GROUP):
        words = [WORD.findall(t.lower()) for t in texts[begin:end]]
        counts = np.array([len(w) for w in words])
        index = np.array(model.numbered(words), np.int64)
        labels = label_words(model.score, index, counts, switch) if model.langs else np.zeros(len(index), np.int64)
        letters = np.array([len(w) for ws in words for w in ws], np.float64)
        text = np.repeat(np.arange(len(words)), counts)
        n = max(1, len(model.langs))
        share = np.bincount(text * n + labels, weights=letters, minlength=len(words) * n).reshape(len(words), n)
        top, total = share.argmax(1), share.sum(1)
        for i in range(len(words)):
            known = model.langs and total[i] > 0
            out.append((model.langs[top[i]], float(share[i, top[i]] / total[i])) if known else (UNKNOWN, 0.0))
    return out


def spans(text: str, model: Model, switch: float = SWITCH) -> list[tuple[int, int, str]]:
    """Spans (start, end, language) of one text, of neighbouring words with the same label."""
    found = list(WORD.finditer(text))
    words = [m.group().lower() for m in found]
    labels = label_words(model.scores(words), np.arange(len(words)), np.array([len(words)]), switch) if words and model.langs else []
    out: list[tuple[int, int, str]] = []
    for m, label in zip(found, labels):
        lang = model.langs[label]
        if out and out[-1][2] == lang:
            out[-1] = (out[-1][0], m.end(), lang)
        else:
            out.append((m.start(), m.end(), lang))
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from about `sample` documents of each language, picked by a hash of id and text; rows without text or language don't count.

    In all no more than 2 * sample times the number of languages come to the driver, those of least hash.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return learn(pd.DataFrame({"text": [], "lang": []}))
    place = F.shiftrightunsigned(F.xxhash64("id", "text"), 11).cast("double") / float(1 << 53)
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample / n))])
    picked = rows.withColumn("place", place).where(F.col("place") < F.element_at(shares, F.col("lang")))
    return learn(picked.orderBy("place", "id", "lang").limit(2 * sample * len(counts)).select("text", "lang").toPandas())


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = LEAST_SHARE, switch: float = SWITCH) -> DataFrame:
    """The rows, with their own columns, whose text has a language that labels at least `least` of its letters."""

    @F.arrow_udf("double")
    def share(texts: pa.Array) -> pa.Array:
        return pa.array([score for _, score in predict(as_text(texts), model, switch)], pa.float64())

    return docs.where(share(F.col(text_col).cast("string")) >= least)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """One row per input row: id, lang_pred string, score double.

    lang_pred is the learned language that labels most of the text's letters, score its share of them. Null texts
    and texts without a letter get 'und' and 0, and so does every text if nothing could be learned. Ties go to the
    language first by name. Texts are read whole; null ids and repeated rows pass through; other columns of `docs`
    don't matter; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predict(as_text(batch.column(1)), model, switch)
            langs, scores = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), langs, scores], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
