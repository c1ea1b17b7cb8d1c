"""Brute-force versions of what SQL can't express, and the cases that the docstrings define."""

import math
import random
import time
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from notelattice.llm import html, language, lm, neardup, quality, queries, sentencepiece, toxicity, warc
from notelattice.llm.arrow_text import chunks

VOCAB = queries.VOCABULARY
SF = "/root/testdata/sf0.01"


def one_chunk(texts):
    return next(chunks(pa.array(texts, pa.string())))


# -- 1: merges one at a time, each candidate looked at anew


def brute_segment(symbols, key, pieces, limit):
    ids, places = list(symbols), list(range(len(symbols)))
    while True:
        best = None
        for i in range(len(ids) - 1):
            made = int(pieces.merged(np.array([ids[i]]), np.array([ids[i + 1]]))[0])
            if made < 0 or sentencepiece._skipped(np.array([key], np.uint64), np.array([places[i]]), np.array([made]), limit)[0]:
                continue
            if best is None or pieces.rank[made] < best[0]:
                best = (pieces.rank[made], i, made)
        if best is None:
            return ids
        _, i, made = best
        ids[i : i + 2], places[i : i + 2] = [made], [places[i]]


def test_dropout_equals_brute_force():
    pieces, rng, limit = sentencepiece.load(VOCAB), random.Random(11), np.uint64(int(0.3 * 2**64))
    words = ["".join(rng.choice("etaoinshrdlu▁") for _ in range(rng.randint(1, 30))) for _ in range(60)]
    symbols = np.concatenate([pieces.char_id[[ord(c) for c in w]] for w in words])
    off = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    keys = np.array([rng.getrandbits(64) for _ in words], np.uint64)
    got, at = sentencepiece.merge_segments(symbols, off, keys, pieces, limit)
    for i in range(len(words)):
        assert got[at[i] : at[i + 1]].tolist() == brute_segment(symbols[off[i] : off[i + 1]].tolist(), keys[i], pieces, limit)


def test_every_occurrence_draws_its_own_merges():
    pieces = sentencepiece.load(VOCAB)
    ids, off = sentencepiece.encode_texts(["international " * 200] * 30, np.arange(30, dtype=np.uint64), pieces, 0.3, 1)
    found, piece, text = Counter(), [], ""
    for i in ids[off[0] : off[-1]].tolist():
        part = pieces.data[i].decode()
        if part.startswith(" ") and text.strip():
            found[tuple(piece)] += 1
            piece, text = [], ""
        piece.append(i)
        text += part
    assert len(found) > 40  # ways to segment one word


# -- 2 quality, 3 language


def test_quality_probability_and_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fit_on = labels.where("doc_id % 2 = 0")
    model = quality.fit(docs, fit_on)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in quality.score(docs.select("doc_id", "text"), model).collect()}
    for d in list(texts)[:40]:
        index, value = next(quality._sparse(one_chunk([texts[d]]), model.bits))
        margin = model.bias + sum(model.weights[i] * v for i, v in zip(index, value, strict=True))
        assert math.isclose(got[d].quality, 1 / (1 + math.exp(-max(-40, min(40, model.slope * margin + model.offset)))), rel_tol=1e-6, abs_tol=1e-9)
    held = [(got[r.doc_id].quality >= 0.5) == bool(r.quality) for r in labels.where("doc_id % 2 = 1 and quality is not null").collect() if r.doc_id in got and not got[r.doc_id].base_failed]
    assert np.mean(held) > 0.95
    bounded = quality.fit(docs, fit_on, max_values=20_000)
    assert bounded.weights is not None and np.array_equal(bounded.weights, quality.fit(docs.repartition(7), fit_on, max_values=20_000).weights)


def test_language_prediction_equals_brute_force(spark):
    rows = [("der Hund und die Katze", "de"), ("le chien et le chat", "fr"), ("the dog and the cat", "en"), ("die Sonne", "de"), (None, "de"), ("sans langue", None)]
    bits, alpha = 12, 0.5
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), bits=bits, alpha=alpha)

    def grams(text):
        out, low = [], "".join(c.lower() if c.isalpha() else " " for c in text)
        for word in low.split():
            padded = f" {word} "
            for n in (1, 2, 3):
                for i in range(len(padded) - n + 1):
                    g = padded[i : i + n]
                    if g.strip() and (n < 3 or g[1] != " "):
                        code = 0
                        for c in g:
                            code = (code << 20) | ord(c)
                        out.append((((code + (n << 60)) * 0x9E3779B97F4A7C15) % 2**64) >> (64 - bits))
        return out

    counts = {k: Counter() for k in ("de", "en", "fr")}
    for text, lang in rows[:4]:
        counts[lang].update(grams(text))
    prior = {"de": 2 / 4, "en": 1 / 4, "fr": 1 / 4}
    tests = ["die Katze", "the cat", "chat", "\U00030000\U00030001", "1234", ""]
    names, score = language.predict_texts(tests, next(model.blocks()))
    for t, name, s in zip(tests, names, score, strict=True):
        g = grams(t)
        if not g:
            assert (name, s) == ("und", 0)
            continue
        total = {k: sum(math.log((c[b] + alpha) / (sum(c.values()) + alpha * 2**bits)) for b in g) / math.sqrt(len(g)) + math.log(prior[k]) for k, c in counts.items()}
        best = max(total, key=total.get)
        assert name == best and math.isclose(s, 1 / sum(math.exp(v - total[best]) for v in total.values()), rel_tol=1e-4)


def test_many_languages_are_all_learned(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    known = {f"l{i:04d}": [word() for _ in range(4)] for i in range(2000)}
    rows = [(" ".join(rng.choices(w, k=6)), x) for x, w in known.items() for _ in range(2)]
    table = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    whole, parted = language.fit(table, bits=12, block=4000), language.fit(table, bits=12, block=700)
    assert whole.n_languages == 2000 and [len(b.languages) for b in parted.blocks()] == [700, 700, 600]
    docs = spark.createDataFrame([(i, " ".join(w), x) for i, (x, w) in enumerate(known.items())] + [(-1, "12", None), (-2, None, None)], "doc_id long, text string, want string")
    one, several = ({r.doc_id: r for r in language.predict(docs, m).collect()} for m in (whole, parted))
    assert all(one[d].lang_pred == several[d].lang_pred and math.isclose(one[d].score, several[d].score, rel_tol=1e-6) for d in one)
    assert np.mean([r.lang_pred == r.want for d, r in several.items() if d >= 0]) > 0.99 and several[-1].lang_pred == several[-2].lang_pred == "und"
    few = language._Sums()
    few.add([x for _, x in rows], [t for t, _ in rows], 12)
    sums = language._Sums()
    for text, x in rows:
        sums.add([x], [text], 12)
    read = lambda s: {(a, b): n for batch in s.rows() for a, b, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
    assert read(few) == read(sums)


# -- 5 toxicity, 7 language model


def test_toxicity_catches_held_out_rows(spark):
    large = "/root/testdata/sf0.1"  # the smaller ones hold half a dozen such rows
    got = {r.doc_id: r.predicted for r in queries.op5_toxicity(spark, large).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{large}/labels.parquet").where("toxic is not null").collect()}
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 5 == 0 and d in got]
    toxic = [got[d] for d in held if labels[d]]
    assert len(toxic) > 50 and np.mean(toxic) > 0.75 and np.mean([got[d] for d in held if not labels[d]]) < 0.02


def test_lm_equals_a_dense_scorer(spark):
    rng = random.Random(3)
    names = ["alpha", "beta", "gamma", "deltas", "omegas", "psi", "rho", "taus", "nus", "mus"]
    texts = [" ".join(rng.choice(names[: 3 + i % 8]) for _ in range(12)) for i in range(60)]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    kinds = 4
    counts = lm.count_words(train, kinds).cache()
    vocab = lm.vocabulary(counts, len(texts), head=4, dictionary=6, kinds=kinds)
    params = lm.train(train, vocab, width=6, batch_size=32)
    c = Counter(w for t in texts for w in t.split())
    order = sorted(c, key=lambda w: (-c[w], int(lm.word_kinds(one_chunk([w]), kinds)[0].view(np.int64)[0])))
    head = order[:4]
    kind = {w: int(lm.word_kinds(one_chunk([w]), kinds)[1][0]) for w in [*names, "unseens"]}
    ids = {w: lm.FIRST + kinds + head.index(w) if w in head else lm.FIRST + kind[w] for w in kind}
    size = [sum(c[w] + 1 for w in c if w not in head and kind[w] == k) + 1 for k in range(kinds)]

    def log_p(word, one, two):
        context = params["r"][one] * params["near"] + params["r"][two] * params["far"]
        s = params["q"] @ context + params["b"]
        z = sum(math.exp(x) for i, x in enumerate(s) if i != lm.BEGIN)
        i = lm.END if word is None else ids[word]
        return s[i] - math.log(z) + (0 if word is None or word in head else math.log((c[word] + 1) / size[kind[word]]))

    asked = [texts[0], "alpha unseens beta rho", "", "nus"]
    got = lm.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), params, vocab, counts, ["doc_id"]).collect()
    for r in got:
        words, one, two, total = asked[r.doc_id].split(), lm.BEGIN, lm.BEGIN, 0.0
        for w in [*words, None]:
            total += log_p(w, one, two)
            one, two = (lm.END if w is None else ids[w]), one
        assert math.isclose(r.score, total / math.log(10), rel_tol=1e-4) and (r.n_tokens, r.n_known) == (len(words) + 1, sum(w in c for w in words) + 1)


# -- 4, 6, 10


def test_archives_of_many_levels_and_odd_pages(spark):
    rows = [(i, f"u{i}", "x" * 3000) for i in range(1500)] + [(None, "n", "lost"), (None, None, None), (7, "again", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    ours = warc.records(pages, 2000)
    assert ours.count() == len(rows) and warc.depth(ours, 4) > warc.depth(ours, 16) > 0
    bad = ours.where("page_id = 1234").first()
    theirs = spark.createDataFrame([r if r.page_id != 1234 else type(r)(**(r.asDict() | {"digest": "0"})) for r in ours.collect()], ours.schema)
    for fan_out in (4, 16):
        assert [tuple(r) for r in warc.audit(ours, theirs, fan_out).collect()] == [(bad.archive, bad.offset, "corrupt")]
    assert warc.records(pages.where("false")).count() == 0


def test_names_in_articles_and_deep_pages():
    long = "Long text, with words and more words. " * 12
    page = f'<article><p class="share-price">Shares rose.</p><p class="text-hidden-gem">A gem.</p><p>{long}</p><div class="share-buttons"><a href=x>Post it</a></div><div class="comment-list"><p>{long}</p></div></article>'
    assert html.main_text(page) == f"Shares rose.\nA gem.\n{long.strip()}"
    began = time.process_time()
    for deep in ("<div>" * 10_000 + "end.", "<p><b>" * 10_000 + "end.", "<i><div>" + "<b>" * 10_000 + "</i>" * 10_000 + "end.", "<svg>" * 10_000 + "end.", "<ul><li>" * 10_000 + "end."):
        html.main_text(deep)
    assert time.process_time() - began < 20


def test_near_duplicates_without_ids_and_with_shared_ids(spark):
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(5, text, "a", 1), (9, text + " tail", "b", 2), (None, text, "c", 3), (9, other, "d", 4), (11, other, "e", 5), (11, other, "e", 5), (12, None, "f", 6), (13, "", "g", 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node string, text_key long")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in neardup.components(frame, 3, 85).collect())
    assert got == [(0, None, True), (5, 5, True), (9, 5, False), (9, 9, True), (11, 9, False), (11, 9, False), (12, 12, True), (13, 13, True)]
    left = neardup.deduplicate(frame, 3, 85)
    assert left.columns == frame.columns and sorted((r.doc_id or 0, r.node) for r in left.collect()) == [(0, "c"), (5, "a"), (9, "d"), (12, "f"), (13, "g")]


# -- the pipeline's stages


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    good = docs.where("length(text) > 400").first()
    odd = [(None, good.text, "en", "s", 1, "k", 0.5, "x"), (900_001, None, None, None, None, None, None, None), (900_002, "", "en", "s", 0, "k", 0.5, "x"), (900_003, "1 2 3", None, "s", 5, "k", 0.5, "x"), (900_004, "wort " * 50_000, "de", "s", 1, "k", 0.5, "x")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)
    extra = spark.createDataFrame([*odd, *odd[3:4]], kinds + ", kept string, score double, ids string")
    frame = docs.selectExpr("*", "'k' as kept", "0.5D as score", "'x' as ids").unionByName(extra)
    out = stage(spark, frame, SF)
    rows = out.collect()
    assert len(rows) <= frame.count()
    if name != "encoding":
        assert out.columns == frame.columns
        stays = {r.doc_id for r in rows}
        assert None in stays and (900_001 in stays) == (name in ("near duplicates", "decontamination"))
        assert sum(r.doc_id == 900_003 for r in rows) == {"near duplicates": 1, "decontamination": 2}.get(name, 0)
    assert stage(spark, frame.where("false"), SF).count() == 0
