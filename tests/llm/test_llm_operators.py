"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd inputs."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notelattice.llm import arrow_text, decontaminate, html, language, licenses, lm, neardup, quality, queries, sentencepiece, toxicity, warc

VOCAB = queries.VOCABULARY
ODD = [None, "", " \n\t ", "a", "éß 中文", "x" * 70_000, "word " * 9_000, "tab\tand\x0bvertical\x0cfeed\r\nline", "nb sp \x1c\x85 unit", "▁ mark ▁▁", "\U0001f600 emoji \U0001f468‍\U0001f469", "<p>", "A-B_c #tag 100% <b> $5 & more | less"]


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def odd_frame(spark):
    """Odd texts, a repeated row, a null id, and extra columns whose names clash with those that operators add."""
    rows = [(1_000_000 + i, t, 1, "x") for i, t in enumerate(ODD)] + [(1_000_003, "a", 1, "x"), (None, "no id here", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score int, kept string").repartition(2)


# -- words


def test_words_and_hashes():
    column = pa.array(ODD)
    seen = {}
    for chunk in arrow_text.chunks(column, limit=50):
        hashes, off = arrow_text.word_hashes(chunk, lower=True)
        for i in range(len(chunk)):
            want = words(lower(ODD[chunk.start + i]))
            assert off[i + 1] - off[i] == len(want)
            for w, h in zip(want, hashes[off[i] : off[i + 1]].tolist(), strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


# -- 1 SentencePiece


def test_encoding_without_dropout_is_the_library_s(texts):
    import sentencepiece as library

    pieces, model = sentencepiece.load(VOCAB), library.SentencePieceProcessor(model_file=VOCAB)
    sample = [t for t in itertools.islice(texts.values(), 40)] + [t for t in ODD if t and "▁" not in t and len(t) < 60_000] + ["  two  spaces ", "a" * 200 + " " + "ab" * 90]
    ids, off = sentencepiece.encode_texts(sample, np.arange(len(sample), dtype=np.uint64), pieces, 0.0, 1)
    for i, t in enumerate(sample):
        assert ids[off[i] : off[i + 1]].tolist() == model.encode(t), t[:80]


@pytest.mark.parametrize("dropout", [0.1, 0.5, 1.0])
def test_dropout_is_seeded_varied_and_lossless(texts, dropout):
    pieces = sentencepiece.load(VOCAB)
    sample = [t for t in itertools.islice(texts.values(), 20)] + [t for t in ODD if t]
    keys = np.arange(len(sample), dtype=np.uint64)
    runs = [sentencepiece.encode_texts(sample, keys, pieces, dropout, seed) for seed in (1, 1, 2)]
    assert np.array_equal(runs[0][0], runs[1][0])
    if dropout < 1:
        assert not np.array_equal(runs[0][0], runs[2][0])
    for ids, off in runs:
        assert [sentencepiece.decode_ids(ids[off[i] : off[i + 1]], pieces) for i in range(len(sample))] == sample


def test_heap_and_rounds_agree():
    pieces, rng = sentencepiece.load(VOCAB), random.Random(4)
    for n in (2, 5, 20, 47):
        symbols = np.array([pieces.char_id[ord(rng.choice("etaoinshr▁"))] for _ in range(n)])
        for limit in (np.uint64(0), np.uint64(1 << 62)):
            got, _ = sentencepiece.merge_segments(symbols.copy(), np.array([0, n]), np.array([99], np.uint64), pieces, limit)
            assert got.tolist() == sentencepiece._heap(symbols.tolist(), 99, pieces, limit)


def test_encode_frames(spark):
    both = sentencepiece.decode(sentencepiece.encode(odd_frame(spark), VOCAB), VOCAB)
    rows = both.collect()
    assert len(rows) == len(ODD) + 2 and all(r.decoded == r.text for r in rows)
    assert {len(r.ids) for r in rows if r.text == ""} == {0} and all(r.ids is None for r in rows if r.text is None)
    assert both.where("false").count() == 0


# -- 2 quality


def brute_base(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(w)
    return n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_base_counts(texts):
    sample = [*texts.values(), *ODD, "a b c\na b c\n\na b c", "p q r s t u v w " * 5, "same\nsame \nsame"]
    for limit in (100, 1 << 19):
        for chunk in arrow_text.chunks(pa.array(sample), limit):
            got = quality.base_counts(chunk)
            for i in range(len(chunk)):
                want = brute_base(sample[chunk.start + i])
                assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) + (bool(got["base_failed"][i]),) == want


def test_quality_features_do_not_depend_on_the_chunk(texts):
    sample = [*itertools.islice(texts.values(), 30), *[t for t in ODD if t and len(t) < 1000]]
    rng = np.random.default_rng(1)
    model = quality.QualityModel(rng.normal(size=1 << 16), 0.1, 1.0, 0.0)
    together = np.concatenate([quality.margins(c, model) for c in arrow_text.chunks(pa.array(sample))])
    alone = np.concatenate([quality.margins(c, model) for t in sample for c in arrow_text.chunks(pa.array([t]))])
    assert np.allclose(together, alone)


def test_quality_query(spark, sf_dir, texts):
    got = {r.doc_id: r for r in queries.op2_quality_rules(spark, sf_dir).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        assert (got[d].n_words, got[d].word_chars, got[d].n_symbols, got[d].n_dup_lines, got[d].n_repeat_words, got[d].base_failed) == brute_base(t)
        assert not (got[d].kept and got[d].base_failed)
    judged = [(labels[d], got[d].kept) for d in labels if d in got and not got[d].base_failed]
    assert np.mean([bool(q) == k for q, k in judged]) > 0.9


def test_quality_odd_and_no_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none)
    rows = quality.score(odd_frame(spark), model).collect()
    assert len(rows) == len(ODD) + 2 and all(r.kept == (not r.base_failed) and r.score == 1 for r in rows)
    assert quality.score(odd_frame(spark).where("false"), model).count() == 0


# -- 3 language


def test_language(spark, sf_dir, docs):
    got = queries.op3_language_id(spark, sf_dir).collect()
    want = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == want[r.doc_id] for r in got if r.held_out]
    assert len(got) == len(want) and np.mean(held) > 0.97


def test_language_counts_equal_brute_force():
    sample = ["Abc d'e", "", "...", "x", "Été a", ". lead", "trail ."]
    got = language.grams(sample, 15)
    alone = [language.grams([t], 15) for t in sample]
    for n in range(3):
        for i, t in enumerate(sample):
            a, off = got[n]
            assert a[off[i] : off[i + 1]].tolist() == alone[i][n][0].tolist()
            run = re.sub(r"[^a-zé]+", " ", f" {t.lower()} ")
            grams = [run[k : k + n + 1] for k in range(len(run) - n)]
            grams = [g for g in grams if (g[0] != " " or g[-1] != " ") and " " not in g[1:-1]]
            assert off[i + 1] - off[i] == len(grams), (t, n)


def test_language_odd(spark, docs):
    model = language.fit(docs.select("text", "lang"))
    rows = language.predict(odd_frame(spark), model).collect()
    assert len(rows) == len(ODD) + 2
    assert {r.lang_pred for r in rows if not any(c.isalpha() for c in r.text or "")} == {"und"}
    empty = language.fit(docs.select("text", "lang").where("false"))
    assert {r.lang_pred for r in language.predict(odd_frame(spark), empty).collect()} == {"und"}


# -- 4 WARC


def test_audit_finds_planted_faults(spark):
    rows = [(f"arc{a}", o * 30_000, f"d{a}-{o}") for a in range(3) for o in range(400)]
    ours = spark.createDataFrame(rows, "archive string, offset long, digest string")
    changed = {rows[5]: "corrupt", rows[450]: "missing", rows[1199]: "corrupt"}
    theirs = [(a, o, d + "!") if changed.get((a, o, d)) == "corrupt" else (a, o, d) for a, o, d in rows if changed.get((a, o, d)) != "missing"] + [("arc9", 7, "new")]
    got = {(r.archive, r.offset, r.status) for r in warc.audit(ours, spark.createDataFrame(theirs, ours.schema)).collect()}
    assert got == {("arc0", 150_000, "corrupt"), ("arc1", 1_500_000, "missing"), ("arc2", 399 * 30_000, "corrupt"), ("arc9", 7, "extra")}
    assert warc.audit(ours, ours.repartition(3)).count() == 0 and warc.audit(ours.where("false"), ours.where("false")).count() == 0
    roots = [warc.root(warc.tree(x, 3, 16)[-1]) for x in (ours, ours.orderBy(F.desc("offset")), spark.createDataFrame(theirs, ours.schema))]
    assert roots[0] == roots[1] != roots[2]


def test_warc_records_round_trip(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "http://a", "<p>é"), (2, None, None), (3, "http://c", ""), (3, "http://c", ""), (None, "http://n", "x")], "page_id long, url string, html string")
    data = [bytes(r.b) for r in pages.select(warc.record_bytes(F.col("url"), F.col("html")).alias("b")).collect()]
    (tmp_path / "plain.warc").write_bytes(b"".join(data))
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(data[0]))
    rows = warc.read_warc(spark, str(tmp_path)).orderBy("archive", "offset").collect()
    assert [bytes(r.payload).decode() for r in rows if r.archive.endswith(".warc")] == ["<p>é", "", "", "", "x"]
    placed = warc.records(pages).orderBy("archive", "offset").collect()
    assert len(placed) == 5 and [r.offset for r in placed if r.archive == "pages-0"] == [0, len(data[0]), len(data[0]) + len(data[1]), len(data[0]) + len(data[1]) + len(data[2])]


def test_warc_query_equals_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = {tuple(r) for r in con.execute(queries.OP4_SQL).fetchall()}
    assert {tuple(r) for r in queries.op4_warc_fixity(spark, sf_dir).collect()} == want and want


# -- 5 toxicity


def test_label_model_recovers_accuracies():
    rng, m = np.random.default_rng(2), len(toxicity.VOTERS)
    truth = rng.random(20_000) < 0.1
    rates = np.stack([np.full(m, 0.01), rng.uniform(0.2, 0.8, m)])
    on = rng.random((len(truth), m)) < rates[truth.astype(int)]
    on[:, 1] = on[:, 0]  # a voter that copies another
    masks = (on << np.arange(m)).sum(axis=1)
    found, n = np.unique(masks, return_counts=True)
    model = toxicity.fit_label_model(found, n.astype(float), None)
    posterior = dict(zip(found.tolist(), model.posterior(found), strict=True))
    assert np.mean([(posterior[int(x)] > 0.5) == t for x, t in zip(masks, truth, strict=True)]) > 0.97
    assert np.abs(model.rates[1][2:] - rates[1][2:]).max() < 0.1
    assert model.correlation[0, 1] > 0.9 and model.weight[0] < 0.7 < model.weight[3]


def test_toxicity_query(spark, sf_dir, docs):
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, sf_dir).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in got.items())
    clean = [got[d].predicted for d, t in labels.items() if not t and d in got]
    assert np.mean(clean) < 0.05


def test_toxicity_finds_insults(spark, docs):
    rng = random.Random(1)
    common = "the of and to in is that it for on was as with be by".split()
    rows = []
    for i in range(600):
        w = [rng.choice(common) + chr(97 + rng.randrange(26)) * rng.randrange(5) for _ in range(60)]
        if i % 6 == 0:
            for k, x in enumerate(rng.sample("idiot clown worthless moron zzgrob zzplif".split(), 3)):
                w[10 * k] = x
        rows.append((i, " ".join(w), int(i % 6 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.where("doc_id < 400"), frame.where("doc_id < 400").select("doc_id", "toxic"))
    got = {r.doc_id: r.predicted for r in toxicity.score(frame, model).collect()}
    assert all(got[i] == t for i, _, t in rows if i >= 400)
    odd = toxicity.score(odd_frame(spark), model).collect()
    assert len(odd) == len(ODD) + 2 and all(r.predicted == 0 for r in odd)
    unlabelled = toxicity.fit(frame.where("false"), frame.where("false").select("doc_id", "toxic"))
    assert toxicity.score(frame, unlabelled).where("predicted = 1").count() > 0


# -- 6 HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="masthead"><a href="/">Home</a> Site name</header><nav><ul><li><a href="/a">One</a></li></ul></nav><!-- ad --><div class="ad">Buy now. It is good, really.</div>
<article><h1>Head &amp; more</h1><p><b>Short.<br><p>A long   paragraph, with &eacute; and
breaks. It goes on, and on; it has <a href="x">a link</a> inside.</p><ul><li>item one<li>item two</ul></article>
<aside class="sidebar">Popular things.</aside><div id="comments"><p>First! I disagree with all of this, and so on.</p></div><form><label>Mail</label></form><footer>&copy; site</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Head & more\nShort.\nA long paragraph, with é and breaks. It goes on, and on; it has a link inside.\nitem one\nitem two"
    soup = PAGE.replace("<article>", "<div><div>").replace("</article>", "</div></div>")
    assert "A long paragraph" in html.main_text(soup) and "Buy now" not in html.main_text(soup) and "disagree" not in html.main_text(soup)
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == "" and html.main_text("just  text") == "just text"
    assert html.main_text("<p>unclosed <b>bold <i>x") == "unclosed bold x"


def brute_article(page):
    """The article of the synthetic pages by pattern: h1 and p blocks between <article> and </article>."""
    import html as entities

    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [entities.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in (re.sub(r"\s+", " ", b).strip() for b in blocks) if x)


def test_html_query(spark, sf_dir):
    got = queries.op6_html_extraction(spark, sf_dir).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    assert all(r.text == brute_article(pages[r.page_id]) for r in got)


def test_html_odd(spark):
    frame = odd_frame(spark).withColumnRenamed("text", "html").withColumn("text", F.lit("clash"))
    rows = html.extract(frame).collect()
    assert len(rows) == len(ODD) + 2 and all(r.n_chars == len(r.text) for r in rows) and html.extract(frame.where("false")).count() == 0


# -- 7 language model


def test_lm_base_scores(spark, sf_dir, texts):
    got = {r.doc_id: r for r in queries.op7_lm_scoring(spark, sf_dir).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    tokens = {d: [*words(lower(t)), None] for d, t in texts.items()}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    assert len(got) == len(texts)
    held_out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held_out) > sum(r.base_score for r in held_out) + 0.05 * sum(r.n_tokens for r in held_out)


def test_lm_small_dictionary_gives_equal_scores(spark, docs):
    rows = docs.select("doc_id", "text").limit(60).unionByName(odd_frame(spark).select("doc_id", "text"))
    counts = lm.count_words(rows).cache()
    out = []
    for dictionary in (1 << 18, 300):
        vocab = lm.vocabulary(counts, rows.count(), head=200, dictionary=dictionary)
        params = lm.start(vocab, 8, 1)
        out.append({(r.doc_id, r.n_tokens): (r.n_known, r.base_score, r.score) for r in lm.score(rows, params, vocab, counts, ["doc_id"]).collect()})
    assert out[0].keys() == out[1].keys() and all(np.allclose(out[0][k], out[1][k]) for k in out[0])


def test_lm_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    hashes = np.sort(rng.integers(1, 1 << 63, 20, dtype=np.uint64))
    totals = np.concatenate([[10, 0, 5], np.full(20, 100)])
    vocab = lm.Vocabulary(hashes, np.full(20, 100), np.arange(3, 23, dtype=np.int32), totals, np.array([16]), 2015, 30, 10)
    model = lm.Nce(lm.start(vocab, 8, 1), vocab, 10, 0.1, 1)
    seq = np.tile(np.arange(3, 23), 400)  # each word tells the next one
    one, two = np.roll(seq, 1), np.roll(seq, 2)
    for _ in range(60):
        model.step(seq, one, two)
    near, far, bias, log_z = lm.tables(model.p)
    p = near[one[:20]] + far[two[:20]] + bias - log_z[two[:20], one[:20]][:, None]
    assert np.allclose(np.exp(p).sum(axis=1), 1, atol=1e-4)
    assert p[np.arange(20), seq[:20]].mean() > np.log(1 / 20) + 1


def test_lm_without_training_rows(spark, docs):
    none = docs.select("text").where("false")
    counts = lm.count_words(none)
    vocab = lm.vocabulary(counts, 0)
    rows = lm.score(odd_frame(spark).select("doc_id", "text"), lm.train(none, vocab), vocab, counts, ["doc_id"]).collect()
    assert len(rows) == len(ODD) + 2 and all(r.n_known == 0 and np.isfinite(r.score) for r in rows)


# -- 8 decontamination


def edit_distance(a, b):
    """Least edit distance of a to any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, 90))) for _ in range(2))
        assert decontaminate.myers(decontaminate.masks_of(a), len(a), b)[0] == edit_distance(a, b)


def test_planted_edits_are_found(spark):
    rng = random.Random(6)
    make = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))
    items = [(i, make(40)) for i in range(30)] + [(90, None), (91, ""), (92, "..."), (93, "Hi you")]
    rows, want = [(500, make(300), "x"), (501, None, "x"), (502, "", "x"), (503, "chi young", "x"), (504, "oh, HI -- you!", "x")], {(504, 93)}
    for i, item in items[:30]:
        norm = decontaminate.normalize(item)
        chars = list(norm)
        budget = int(len(norm) * 0.08)
        for _ in range(i % (budget + 1)):
            k = rng.randrange(len(chars))
            chars[k : k + 1] = rng.choice([["q"], [], ["z", chars[k]]])
        rows.append((i, make(50) + "\n" + "".join(chars).upper() + ", " + make(20), "x"))
        want.add((i, i))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (20_000, 7):
        found = decontaminate.matches(docs, bench, block=block).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want
    for r in found:
        item, text = decontaminate.normalize(dict(items)[r.item_id]), decontaminate.normalize(next(t for d, t, _ in rows if d == r.doc_id))
        assert edit_distance(f" {item} ", f" {text} ") == r.distance
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {500, 501, 502, 503}
    assert decontaminate.matches(docs, bench.where("false")).count() == 0 and decontaminate.matches(docs.where("false"), bench).count() == 0


def test_no_item_is_lost_and_one_border_rule(spark):
    docs = spark.createDataFrame([(i, f"before the {w} passage of words after it") for i, w in enumerate(("red", "green", "blue", "black", "white"))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, f"the {w} passage of words") for w in ("red", "green", "blue", "black", "white")] * 2, "item_id long, text string")
    for block in (1, 2, 20_000):
        exact = [r.doc_id for r in decontaminate.matches(docs, bench, block=block).collect() if r.distance == 0]
        assert sorted(exact) == [0, 1, 2, 3, 4]
        assert decontaminate.clean(docs, bench, block=block).count() == 0
    border = spark.createDataFrame([(12, "twelve chars"), (13, "thirteen char")], "item_id long, text string")
    cases = [("see twelve chars here", {12}), ("see xtwelve chars here", set()), ("see twelve charsx here", set()), ("so thirteen char it is", {13}), ("so thirteen charx it is", {13}), ("so xthirteen charx it is", set())]
    for text, want in cases:
        got = decontaminate.matches(spark.createDataFrame([(1, text)], "doc_id long, text string"), border).collect()
        assert {r.item_id for r in got} == want, text
        for r in got:
            norm = decontaminate.normalize(text)
            assert norm[r.begin : r.end].strip() == norm[r.begin : r.end] and abs(len(norm[r.begin : r.end]) - r.item_id) <= 1
    rows = spark.createDataFrame([(5, "it holds twelve chars, yes"), (5, "clean text"), (None, "twelve chars"), (6, None)], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in decontaminate.clean(rows, border).collect()} == {(5, "clean text"), (6, None)}


def test_edit_search_equals_dynamic_programming(spark, sf_dir, texts):
    """All items against whole texts, one character of the text at a time."""
    items = [(r.item_id, f" {decontaminate.normalize(r.text)} ") for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rng = random.Random(9)
    docs = {d: t for d, t in texts.items() if t and len(t) < 3000}
    for d in rng.sample(sorted(docs), 60):  # copies with edits, about as many as the budget
        item = list(rng.choice(items)[1].strip())
        for _ in range(rng.randrange(int(len(item) * 0.08) + 3)):
            k = rng.randrange(len(item))
            item[k : k + 1] = rng.choice([["q"], [], ["z", item[k]]])
        docs[d] = docs[d][:800] + " " + "".join(item) + " " + docs[d][800:1600]
    width = max(len(x) for _, x in items)
    codes = np.zeros((len(items), width), np.int64)
    for i, (_, x) in enumerate(items):
        codes[i, : len(x)] = [ord(c) for c in x]
    steps, size = np.arange(width + 1), np.array([len(x) for _, x in items])
    budget = ((size - 2) * 0.08).astype(int)
    want = set()
    for d, t in docs.items():
        row = np.tile(steps, (len(items), 1))
        best = np.full(len(items), width)
        for c in f" {decontaminate.normalize(t)} ":
            new = np.empty_like(row)
            new[:, 0] = 0
            new[:, 1:] = np.minimum(row[:, :-1] + (codes != ord(c)), row[:, 1:] + 1)
            row = np.minimum.accumulate(new - steps, axis=1) + steps
            best = np.minimum(best, row[np.arange(len(items)), size])
        want |= {(d, items[i][0], int(best[i])) for i in np.flatnonzero(best <= budget)}
    found = decontaminate.matches(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()
    assert len(want) > 40 and {(r.doc_id, r.item_id, r.distance) for r in found} == want


def test_decontamination_query(spark, sf_dir, texts):
    items = {r.item_id: decontaminate.normalize(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    exact = {(d, i) for d, t in texts.items() for i, x in items.items() if f" {x} " in f" {decontaminate.normalize(t)} "}
    got = queries.op8_decontamination(spark, sf_dir).collect()
    assert exact <= {(r.doc_id, r.item_id) for r in got}
    assert {(r.doc_id, r.item_id) for r in got if r.distance == 0} == exact


# -- 9 licenses


def brute_licenses(text, percent=80):
    """Templates whose shingles stand by `percent` in a window of the template's class."""
    w = [x for x in re.split("[^a-z0-9]+", (text or "").lower()) if x]
    s = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    found = set()
    for name, body in licenses.TEMPLATES.items():
        b = [x for x in re.split("[^a-z0-9]+", body.lower()) if x]
        t = {tuple(b[i : i + 3]) for i in range(len(b) - 2)}
        c = licenses.class_of(len(t))
        if any(100 * len(t & set(s[i : i + 2 * c])) >= percent * len(t) for i in range(0, max(1, len(s)), c)):
            found.add(name)
    return found


def test_license_scan(spark, texts):
    extra = {10_000 + i: f"lead words here {b} and a tail of words" for i, b in enumerate(licenses.TEMPLATES.values())}
    extra |= {20_000: "Licensed under the Apache Licence", 20_001: None, 20_002: "", 20_003: " ".join(licenses.TEMPLATES.values()) * 3, 20_004: "a b"}
    rows = [*texts.items(), *extra.items()]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, set()).add(r.template)
    assert {d: s for d, t in rows if (s := brute_licenses(t))} == got
    assert len(found) == sum(map(len, got.values()))
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame(rows[:1], "doc_id long, text string"), {"short": "two words"})


# -- 10 near duplicates


def brute_components(texts, size, percent):
    sets = {}
    for d, t in texts.items():
        w = words(lower(t))
        sets[d] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    where, parent = {}, {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    for d, s in sets.items():
        shared = Counter(e for x in s for e in where[x] if e < d)
        for e, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[e]) - k):
                a, b = top(d), top(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), top(d)) for d, s in sets.items()}


def near_copies(n, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(110)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.choice(edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(25)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small_bucket", [1, 32])
def test_components_equal_brute_force(spark, texts, monkeypatch, small_bucket):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small_bucket)
    rows = dict(texts) | {5000 + i: t for i, t in enumerate([*near_copies(120, [1, 1, 2, 2, 3, 4], 1), *ODD, "one two", "One TWO", "a b c", "A b\tC"])}
    got = neardup.components(spark.createDataFrame([*rows.items(), (5000, rows[5000]), (None, "w w w")], "doc_id long, text string"), size=3, percent=85).collect()
    want = brute_components(rows, 3, 85)
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_circulant_signatures_estimate_jaccard():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 63, 400, dtype=np.uint64), rng.integers(0, 1 << 63, 80, dtype=np.uint64)
    x, y = a, np.concatenate([a[80:], b])
    s = neardup.signatures(np.concatenate([x, y]), np.array([0, 400, 800]), 240)
    assert abs((s[0] == s[1]).mean() - 320 / 480) < 0.12


def test_deduplicate(spark):
    frame = odd_frame(spark)
    got = neardup.deduplicate(frame).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [1_000_000 + i for i in range(len(ODD))] and sum(r.doc_id is None for r in got) == 1
    assert neardup.deduplicate(frame.where("false")).count() == 0 and neardup.components(frame.where("false")).count() == 0
