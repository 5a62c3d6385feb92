"""Operators of the training-data subpackage against brute force, libraries and round trips, with edge cases."""

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from tessera.llm import components, html_text, language, lattice, mixing, neighbours, pieces, sharding, simhash, token_counts, toxicity
from tessera.llm._xxh64 import xxh64
from tessera.llm.components import connected_components

PIECES, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("id", T.StringType()), T.StructField("rank", T.StringType())]
)
ODD = [
    (1, "one two three four five six", "en", "b", "x", "y"), (2, "one two three four five six", "en", "b", None, None), (2, "one two three four five six", "en", "b", None, None),
    (3, None, None, None, "", ""), (4, "", "en", "a", "", ""), (5, " \t\n", "de", "a", "", ""), (None, "no id here", "en", None, "", ""),
    (6, "x" * 60000 + " " + "word " * 3000, "en", "a", "", ""), (7, "▁ 日本語 👍 \x00 ok", None, "c", "", ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# pieces


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(blacklist_categories=["Cs"]), st.sampled_from("aei st▁  \n")), max_size=60), max_size=6))
def test_pieces_are_lossless(texts):
    found = list(pieces.sample(texts, np.arange(len(texts)).astype(np.uint64), PIECES, 0.5))
    assert [pieces.decode_ids(x.tolist(), PIECES) for x in found] == texts


def test_pieces_follow_the_law():
    """Frequencies of sampled segmentations against all segmentations enumerated."""
    n, vocab = 20000, pieces.vocabulary(PIECES)
    seeds = (np.arange(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    found = [tuple(x.tolist()) for x in pieces.sample(["there"] * n, seeds, PIECES, 0.5)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def ways(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if (i := model.piece_to_id(s[:k])) > 258:
                yield from ((i, *rest) for rest in ways(s[k:]))

    weight = {w: np.exp(0.5 * sum(vocab.log_weight[i] for i in w)) for w in ways("▁there")}
    total = sum(weight.values())
    assert set(found) <= set(weight)
    assert max(abs(found.count(w) / n - weight[w] / total) for w in weight) < 0.02


def test_pieces_of_odd_rows(odd, none):
    rows = pieces.round_trip(odd, PIECES).collect()
    assert len(rows) == len(ODD) and all(r.lossless for r in rows)
    assert {r.n_pieces for r in rows if r.doc_id in (3, 4)} == {0}
    assert len({r.pieces_crc32 for r in rows if r.doc_id == 2}) == 1
    back = pieces.decode(pieces.encode(odd, PIECES), PIECES).collect()
    assert sorted(r.text for r in back) == sorted(x[1] or "" for x in ODD)
    assert pieces.round_trip(none, PIECES).count() == 0


# toxicity


def test_toxicity_learns_and_locates(spark, odd, none):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(300):
        sentences = [" ".join(rng.choice(words, 8)) for _ in range(5)]
        if i % 3 == 0:
            sentences[i % 5] += " vile" + "abcde"[i % 5]
        texts.append(". ".join(sentences))
        labels.append(int(i % 3 == 0))
    texts = [re.sub(r"\d", lambda m: "klmnopqrst"[int(m[0])], t) for t in texts]
    model = toxicity.learn(texts[:200], labels[:200])
    held = [(model.score(t) >= 0.3) == bool(y) for t, y in zip(texts[200:], labels[200:])]
    assert np.mean(held) > 0.97
    docs = spark.createDataFrame([(1, "Fine day here. You vilea thing! Good bye.")], "doc_id long, text string")
    found = toxicity.offending_sentences(docs, model).collect()
    assert [r.sentence.strip() for r in found] == ["You vilea thing!"]
    rows = toxicity.score_documents(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_documents(none, model).count() == 0
    labels_table = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.train(odd, labels_table).score("anything") >= 0
    assert toxicity.train(none, labels_table).score("anything") == 0


# sharding


def test_shards_grow_into_the_new_one_only(spark, none, odd):
    docs = spark.createDataFrame([(i, "t" * (i % 7)) for i in range(4000)], "doc_id long, text string")
    rows = sharding.shard_rows(docs, 16).collect()
    assert {r.grown_shard for r in rows if r.grown_shard != r.shard} == {16}
    sizes = np.bincount([r.shard for r in rows], minlength=16)
    assert sizes.min() > 180 and sizes.max() < 320
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert all(r.text_crc32 == zlib.crc32(b"t" * (r.doc_id % 7)) and r.size == r.doc_id % 7 + 1 for r in rows)
    found = sharding.shard_rows(odd, 16).collect()
    assert len(found) == len(ODD) and {r.size for r in found if r.doc_id == 3} == {1}
    assert sharding.shard_rows(none, 16).count() == 0


def test_weights_confine_movement(spark):
    """A rack that grows heavier only takes rows; rows leave no other rack for a third one within another region."""
    tree = sharding.tree(16)
    heavier = {r: {k: dict(s) for k, s in racks.items()} for r, racks in tree.items()}
    heavier["r1"]["k0"][8] = 3.0
    ids = spark.range(3000).select(sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), heavier).alias("b"))
    for r in ids.where("a <> b").collect():
        assert r.b >= 8  # movers go to the region that grew


# mixing


def test_targets_share_out_by_weight():
    assert mixing.targets([100, 100, 100]) == [200.0, 250 / 3, 500 / 3]
    assert mixing.targets([0, 10]) == [0.0, 15.0]
    assert mixing.targets([]) == []


def test_splitting_tree_is_exact():
    quotas = np.array([1000, 7, 0, 333])
    dealt = mixing.split_tree(quotas, 16, np.random.default_rng(1))
    assert (dealt.sum(1) == quotas).all() and (dealt >= 0).all() and np.ptp(dealt.sum(0)) <= 4


def test_mix_comes_near_targets(spark, odd, none):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, "w " * int(rng.integers(1, 60)), f"s{min(i % 9, 4)}") for i in range(3000)], "doc_id long, text string, source string")
    rows = mixing.mix_plan(docs).collect()
    again = {r.doc_id: r.copies for r in mixing.mix_plan(docs.repartition(7)).collect()}
    assert {r.doc_id: r.copies for r in rows} == again
    taken, target = {}, {}
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for r in rows:
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.size * r.copies
        target[source[r.doc_id]] = r.target
        assert r.copies <= 2 and len(r.shards) == r.copies
    assert all(abs(taken[s] - target[s]) <= 0.005 * target[s] + 2 for s in taken)
    assert mixing.mix(docs).count() == sum(r.copies for r in rows)
    assert mixing.mix_plan(odd).count() == len(ODD)
    assert mixing.mix_plan(none).count() == 0
    assert set(mixing.mix(odd).columns) == {*odd.columns, "mix_shard", "mix_order"}


def test_mix_comes_near_targets_beside_a_long_document(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (20000 if i % 2000 == 0 else 10), f"s{i // 2000}") for i in range(24000)], "doc_id long, text string, source string"
    )
    rows = mixing.mix_plan(docs).collect()
    taken, target = {}, {}
    for r in rows:
        s = r.doc_id // 2000
        taken[s] = taken.get(s, 0) + r.size * r.copies
        target[s] = r.target
    assert all(abs(taken[s] - target[s]) <= 10 for s in taken)
    shards = [k for r in rows for k in r.shards]
    assert set(shards) == set(range(mixing.SHARDS)) and mixing.mix(docs).count() == len(shards)


# embeddings


def _vectors(rng):
    base = rng.standard_normal((60, 64))
    rows = [*base, *(base[:20] + 0.1 * rng.standard_normal((20, 64))), *(base[0] + 0.02 * rng.standard_normal((90, 64))), base[3], 2 * base[4]]
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows)] + [(900, None), (901, [0.0] * 64), (902, [float("nan")] + [1.0] * 63), (903, []), (904, [1.0, None]), (None, [float(x) for x in base[5]])]


@pytest.mark.parametrize("tile", [2048, 16])
def test_lattice_finds_links(spark, tile):
    rows = _vectors(np.random.default_rng(3))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in lattice.vector_groups(table, tile=tile).collect()}
    good = [(i, lattice.units(np.array([v]))[0]) for i, v in rows if v and len(v) == 64 and np.isfinite(v).all() and any(v)]
    cosine = np.array([u for _, u in good]) @ np.array([u for _, u in good]).T >= 0.95
    for k, (i, _) in enumerate(good):
        assert found[i].n_links == cosine[k].sum() - 1, i
        if i is not None:
            assert found[i].component_id == min(j for (j, _), c in zip(good, cosine[k]) if c and j is not None)
    assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i in (900, 901, 902, 903, 904))
    assert lattice.vector_groups(table.limit(0)).count() == 0


def test_e8_points_are_nearest():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 8)) * 1.5
    p = lattice.nearest_e8(x)
    q = lattice.next_e8(x, p)
    gap = lambda y: ((x - y) ** 2).sum(1)
    others = lattice.nearest_e8(x + 0.3 * rng.standard_normal(x.shape))
    assert (gap(p) <= gap(others) + 1e-12).all() and np.allclose(((p - q) ** 2).sum(1), 2)
    different = (others != p).any(1)
    assert (gap(q)[different] <= gap(others)[different] + 1e-12).all()


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 32)) + 2 * rng.integers(0, 2, (3000, 1))
    table = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(3000, None), (3100, [0.0] * 32), (None, [1.0] * 32)], "vec_id long, embedding array<double>")
    rows = neighbours.nearest_neighbours(table).collect()
    hits = total = 0
    for q in range(0, 3000, 100):
        gap = np.sqrt(((x - x[q]) ** 2).sum(1))
        gap[q] = np.inf
        best = set(np.argsort(gap)[:10].tolist())
        mine = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(r.score == pytest.approx(gap[r.vec_id], abs=1e-12) for r in mine)
        hits, total = hits + len(best & {r.vec_id for r in mine}), total + 10
    assert hits / total >= 0.9
    assert neighbours.nearest_neighbours(table.limit(0)).count() == 0
    few = neighbours.nearest_neighbours(table.where("vec_id < 4")).collect()
    assert [r.vec_id for r in few] and len(few) == 3


@pytest.mark.parametrize("copies", [12, 300])
def test_neighbours_among_copies(copies):
    rng = np.random.default_rng(5)
    for group in range(40):
        far = rng.standard_normal((200, 64))
        rows = np.vstack([far, np.repeat(rng.standard_normal((1, 64)), copies, axis=0)])
        ids = np.arange(len(rows))[::-1].copy()
        _, found, gaps = neighbours.scan(rows[-1:], ids[-1:], rows, ids, 10)
        assert found.tolist() == list(range(1, 11)) and (gaps == 0).all(), group


# simhash


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=100), min_size=1, max_size=8))
def test_xxh64_equals_the_library(parts):
    joined = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    assert xxh64(joined, np.cumsum(sizes) - sizes, sizes, 42).tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def _fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd):
    texts = [x[1] or "" for x in ODD]
    assert simhash.text_fingerprints([t.encode() for t in texts], 4).tolist() == [_fingerprint(t) for t in texts]


@pytest.mark.parametrize("tile", [32768, 40])
def test_links_against_all_pairs(spark, tile):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 150).astype(np.uint64)
    near = np.concatenate([base] + [base ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 63, (3, 2))])
    prints = np.unique(near)
    table = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    groups = {r.node: r.root for r in connected_components(simhash.link_forest(table, 4, tile)).collect()}
    met = [(i, j) for i in range(len(prints)) for j in range(i) if np.bitwise_count(prints[i] ^ prints[j]) <= 4]
    parent = simhash.forest(len(prints), [tuple(np.array(met).T)])
    signed = prints.view(np.int64)
    wanted = {}
    for i, r in enumerate(parent):
        wanted.setdefault(int(r), set()).add(int(signed[i]))
    got = {}
    for p in signed.tolist():
        got.setdefault(groups.get(p, p), set()).add(p)
    assert sorted(map(sorted, wanted.values())) == sorted(map(sorted, got.values()))


def test_rounds_of_components_are_small_plans(spark, monkeypatch):
    exchanges, settled = [], components.settled

    def seen(df):
        out = settled(df)
        exchanges.append(df._jdf.queryExecution().sparkPlan().toString().count("Join") + df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return out

    monkeypatch.setattr(components, "settled", seen)
    hub = [(0, i) for i in range(1, 40)]
    rows = hub + [(i + 1, i) for i in range(100, 130)] + [(200, 200), (None, 1), (301, 300), (300, 301)]
    found = connected_components(spark.createDataFrame(rows, "a long, b long"))
    wanted = {i: 0 for i in range(40)} | {i: 100 for i in range(100, 131)} | {300: 300, 301: 300}
    assert sorted((r.node, r.root) for r in found.collect()) == sorted(wanted.items())
    assert len(exchanges) > 8 and max(exchanges) <= 16, exchanges  # a plan over a plan has dozens


def test_simhash_of_odd_rows(odd, none):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == len(ODD)
    by_id = {r.doc_id: r.component_id for r in rows}
    assert by_id[1] == by_id[2] == 1 and by_id[3] == by_id[4] == by_id[5] == 3
    assert simhash.simhash_groups(none).count() == 0
    kept = simhash.keep_first(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 6, 7] and len(kept) == 5


def test_near_copies_without_ids_of_their_own(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(12)]
    rows = [(None, t) for t in texts[:5]] + [(None, texts[0]), (1, texts[5]), (1, texts[6]), (2, texts[5]), (None, texts[6]), (3, texts[7]), (3, texts[7])]
    rows += [(0, texts[8]), (4, texts[8]), (4, texts[9]), (None, None), (5, ""), (6, texts[10]), (7, texts[11])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in simhash.keep_first(docs).collect()]
    wanted = [(None, t) for t in texts[:5]] + [(1, texts[5]), (1, texts[6]), (3, texts[7]), (0, texts[8]), (4, texts[9]), (5, ""), (6, texts[10]), (7, texts[11])]
    assert sorted(kept, key=str) == sorted(wanted, key=str)


# token counts


def test_counts_equal_the_library(odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    rng = np.random.default_rng(7)
    alphabet = list("abe st'rl vm d  \n\t<|>1½éß日👍.,!?-") + ["<|endoftext|>", "'ll", " ", "　"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 150))) for _ in range(400)] + [x[1] or "" for x in ODD] + ["a" * 3000, " " * 2000 + "x", "don't've  'S"]
    texts += ["".join(map(chr, range(a, a + 256))) for a in range(0, 0x3000, 256)]
    wanted = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_tokens(texts, BPE) == wanted
    rows = token_counts.token_counts(odd, BPE).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len(library.encode(x[1] or "", add_special_tokens=False).ids) for x in ODD)
    assert token_counts.token_counts(none, BPE).count() == 0


def test_counts_with_a_table_that_overflows(monkeypatch):
    texts = ["many different words stand here " * 3, "other strings follow: qxz jjk 12345"]
    wanted = token_counts.count_tokens(texts, BPE)
    monkeypatch.setattr(token_counts, "SLOTS", 64)
    small = token_counts.MergeTransducer(BPE)
    monkeypatch.setattr(token_counts, "transducer", lambda path: small)
    assert token_counts.count_tokens(texts, BPE) == wanted


# html


PAGE = """<html><head><title>T</title><script>var x = "<p>";</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site and you should accept that it is so for all of us.</div>
<article><h1>A &amp; B</h1><p>First <b>bold</b> paragraph&nbsp;here<br>goes on with the words that it has.<p>Second.</article>
<div id="comments"><p>I think that this is the best of all the articles that I have read in a long time.</p></div>
<form><label>Your name</label><input name=q></form><footer>&copy; 2020</footer>"""


def test_main_text(spark):
    assert html_text.main_text(PAGE) == "A & B First bold paragraph here goes on with the words that it has. Second."
    assert html_text.main_text("") == "" and html_text.main_text("<p>") == "" and html_text.main_text("<<>><a b") is not None
    bare = "<body><div><a href=x>one</a> <a href=y>two</a></div><p>" + "This is what the page is about and it is all that we have of it. " * 6 + "</p><p>Short one.</p><p>" + "And so it was that they had all of the things that they were to have. " * 5
    assert html_text.main_text(bare).startswith("This is what") and "Short one." in html_text.main_text(bare) and "two" not in html_text.main_text(bare)
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, "v", "", "")], "page_id long, url string, html string, text string")
    rows = html_text.extract(pages).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows) and {r.n_chars for r in rows if r.page_id == 2} == {0}
    assert html_text.extract(pages.limit(0)).count() == 0


# language


def _model(langs=("de", "en")):
    import pandas as pd

    words = {"de": "der die und nicht ist das ein auch für über schön weiß wir haben".split(), "en": "the and not this that with have which from there would".split(), "ru": "это как так и что он она".split()}
    rng = np.random.default_rng(8)
    rows = [(" ".join(rng.choice(words[lang], 30)), lang) for lang in langs for _ in range(30)]
    return language.learn(pd.DataFrame(rows, columns=["text", "lang"]))


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(9)
    for n in range(1, 7):
        scores = rng.normal(0, 5, (n, 2)).astype(np.float32)
        found = language.label_words(scores, np.arange(n), np.array([n]), 3.0)
        total = lambda path: sum(scores[i, s] for i, s in enumerate(path)) - 3.0 * sum(a != b for a, b in zip(path, path[1:]))
        best = max((tuple(int(b) for b in f"{k:0{n}b}") for k in range(2**n)), key=total)
        assert total(tuple(found.tolist())) == pytest.approx(total(best), abs=1e-4)


def test_language_of_spans_and_odd_rows(odd, none):
    model = _model(("de", "en", "ru"))
    text = "this that with have which from und nicht ist das ein auch für wir haben"
    assert [x[2] for x in language.spans(text, model)] == ["en", "de"]
    assert language.predict(["это как так"], model)[0][0] == "ru"
    rows = language.identify(odd, model).collect()
    assert len(rows) == len(ODD) and {(r.lang_pred, r.score) for r in rows if r.doc_id in (3, 4, 5)} == {("und", 0.0)}
    assert language.identify(none, model).count() == 0
    empty = language.train(none)
    assert language.predict(["some words"], empty) == [("und", 0.0)]
    assert language.keep_identified(odd, model).columns == odd.columns


# pipeline


def test_pipeline_runs_stage_by_stage(spark):
    import corpus_pipeline

    sf, docs = "/root/testdata/sf0.001", None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settled(stage(spark, docs, sf))
        sizes.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert sizes[0] >= 0.95 * n and sizes[1] <= sizes[0] and sizes[2] <= sizes[1] and sizes[4] == sizes[3]
    assert docs.where("NOT lossless").isEmpty()


def test_stages_send_small_batches_to_python(spark):
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a word "), 1400).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    try:
        corpus_pipeline.encode_pieces(spark, docs, "")
        seen = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in seen) == 2000 and max(r.size for r in seen) < 1.2 * corpus_pipeline.BATCH
    finally:
        spark.conf.unset(key)
