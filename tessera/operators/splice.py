"""Splicing: edits of a sentence as data, applied in one expression with the offsets of the cues that they bring.

An edit is (at, until, pieces): the characters from `at` to before `until` give way to the pieces, of which those marked
are cues. Offsets are in characters; at = until is an insertion.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions import parsed

EDIT = "struct<at:int,until:int,pieces:array<struct<t:string,cue:boolean>>>"
EDITS = f"array<{EDIT}>"


def piece(words: Column | str, cue: bool = False) -> Column:
    return F.struct((F.lit(words) if isinstance(words, str) else words).alias("t"), F.lit(cue).alias("cue"))


def edit(at: Column, until: Column, *pieces: Column) -> Column:
    return F.struct(at.alias("at"), until.alias("until"), F.array(*pieces).alias("pieces"))


def edits_of(at: Column, until: Column, pieces: Column) -> Column:
    """An edit whose pieces are an array."""
    return F.struct(at.alias("at"), until.alias("until"), pieces.alias("pieces"))


def insert(at: Column, words: Column | str, cue: bool = False) -> Column:
    return edit(at, at, piece(words, cue))


def replace(t: Column, words: Column | str, cue: bool = False) -> Column:
    """A token gives way to words."""
    return edit(t["idx"], parsed.ends_at(t), piece(words, cue))


def delete(t: Column) -> Column:
    return replace(t, "")


def mark(tok: Column, cues: Column, edits: Column) -> Column:
    """The edits with the tokens at the places `cues` marked as cues: inside an edit its pieces are, else the token stands for itself."""
    covered = lambda i, e: (e["at"] <= parsed.token(tok, i)["idx"]) & (parsed.token(tok, i)["idx"] < e["until"])
    flagged = F.transform(
        edits,
        lambda e: F.struct(
            e["at"].alias("at"),
            e["until"].alias("until"),
            F.transform(e["pieces"], lambda p: F.struct(p["t"].alias("t"), (p["cue"] | F.exists(cues, lambda i: covered(i, e))).alias("cue"))).alias("pieces"),
        ),
    )
    own = F.transform(F.filter(cues, lambda i: ~F.exists(edits, lambda e: covered(i, e))), lambda i: replace(parsed.token(tok, i), parsed.token(tok, i)["text"], True))
    return F.concat(flagged, own)


def _spaced(words: Column) -> Column:
    """Single blanks, none first or before , . ; : ! ?; a last one stays."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(words, r"\s+", " "), "^ ", ""), r" ([,.;:!?])", "$1")


def recased(base: Column, variant: Column) -> Column:
    """The variant with a capital first letter if the base's first letter is one."""
    capital = base.rlike(r"^\P{L}*\p{Lu}")
    before = F.length(F.regexp_extract(variant, r"^\P{L}*", 0))
    raised = F.concat(F.substr(variant, F.lit(1), before), F.upper(F.substr(variant, before + 1, F.lit(1))), F.substr(variant, before + 2))
    return F.when(capital, raised).otherwise(variant)


def spliced(text: Column, edits: Column) -> Column:
    """(variant, cue_tokens, cue_char_spans) of the edits; edits that overlap raise an error."""
    ordered = F.array_sort(edits)
    clash = F.exists(F.sequence(F.lit(1), F.greatest(F.size(ordered) - 1, F.lit(1))), lambda k: F.get(ordered, k)["at"] < F.get(ordered, k - 1)["until"])
    kept = lambda at, until: piece(F.substr(text, at + 1, until - at))
    empty = F.array().cast("array<struct<t:string,cue:boolean>>")
    parts = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("pos"), empty.alias("out")),
        lambda done, e: F.struct(e["until"].alias("pos"), F.concat(done["out"], F.array(kept(done["pos"], e["at"])), e["pieces"]).alias("out")),
        lambda done: F.concat(done["out"], F.array(kept(done["pos"], F.length(text)))),
    )
    parts = F.when(clash, F.raise_error(F.concat(F.lit("edits overlap: "), F.to_json(ordered)))).otherwise(parts)
    joined = F.array_join(F.transform(parts, lambda p: p["t"]), "")

    def words_of(p: Column, before: Column) -> Column:
        """(start, length) of each word of a cue."""
        lead = before + F.length(F.regexp_extract(p["t"], r"^\s*", 0))
        words = F.regexp_extract_all(p["t"], F.lit(r"\S+"), F.lit(0))
        far = lambda k: F.aggregate(F.slice(words, F.lit(1), k), F.lit(0), lambda n, w: n + F.length(w) + 1)
        return F.transform(words, lambda w, k: F.struct((lead + far(k)).alias("start"), F.length(w).alias("n")))

    none = F.array().cast("array<struct<start:int,n:int>>")
    cues = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("len"), none.alias("found")),
        lambda done, p: F.struct(
            (done["len"] + F.length(p["t"])).alias("len"), F.concat(done["found"], F.when(p["cue"], words_of(p, done["len"])).otherwise(none)).alias("found")
        ),
        lambda done: F.array_sort(done["found"]),
    )
    variant = recased(text, F.trim(_spaced(joined)))
    spans = F.transform(cues, lambda c: F.struct(F.length(_spaced(F.substr(joined, F.lit(1), c["start"]))).alias("start"), c["n"].alias("n")))
    return F.struct(
        variant.alias("variant"),
        F.transform(spans, lambda s: F.substr(variant, s["start"] + 1, s["n"])).alias("cue_tokens"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] + s["n"]).alias("end"))).alias("cue_char_spans"),
    )
