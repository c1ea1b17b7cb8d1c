"""Collocations, ranked search and URL filters against brute-force versions, and their defined cases."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from notelattice.llm import phrases, queries, search, urls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_ranked_search", "op13_url_filter"])
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


# -- 11


def brute_collocations(rows, least, longest, percent, top):
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low(text)):
            words = re.findall("[^ \t]+", piece)
            sizes[lang or "und"] += len(words)
            counts.update((lang or "und", tuple(words[i : i + n])) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    often, out = {k: v for k, v in counts.items() if v >= least}, {}
    inside = Counter()
    for (lang, words), f in often.items():
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                inside[lang, words[i : i + n]] = max(inside[lang, words[i : i + n]], f)
    for (lang, words), a in often.items():
        if len(words) > 1 and not (inside[lang, words] and 100 * inside[lang, words] >= percent * a):
            score, _, left, right = min((2_000_000 * a // (often[lang, words[:k]] + often[lang, words[k:]]), k, often[lang, words[:k]], often[lang, words[k:]]) for k in range(1, len(words)))
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return {(lang, k, p.decode(), -a, left, right, sizes[lang], -s) for lang, found in out.items() for k, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)}


def test_collocations_equal_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["the", "of", "New", "york", "é", "中文", "a-b", "x"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", "]) for _ in range(n))
    rows = [(text(rng.randint(0, 60)), rng.choice(["en", "en", "de", None])) for _ in range(300)] + [(None, "en"), ("", None), (" \t.", "fr"), ("w" * 70_000 + " the of", "en"), (text(20_000), "de")] + [("same text again", "en")] * 50
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, phrase int").repartition(5)
    for bits in (None, 6 + 10):
        got = {tuple(r) for r in phrases.collocations(docs, 6, 4, 80, 40, bits).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
        assert got == brute_collocations(rows, 6, 4, 80, 40)
    assert phrases.collocations(docs.where("false")).count() == 0


def test_sketches_never_underestimate_and_phrases_flow_over(spark, ):
    rng = np.random.default_rng(4)
    hashes = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)[rng.zipf(1.3, 200_000) % 5000]
    sketch = np.zeros((phrases.DEPTH, 1 << 10), np.uint8)
    for part in np.array_split(hashes, 7):
        phrases.add(sketch, part, 10)
    distinct, n = np.unique(hashes, return_counts=True)
    assert (phrases.estimate(sketch, distinct, 10) >= np.minimum(n, phrases.FULL)).all()
    rows = [(f"alpha beta gamma {i % 7} delta", "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    want = brute_collocations(rows, 30, 4, 80, 2000)
    assert {tuple(r) for r in phrases.collocations(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()} == want


def test_marks_say_what_a_sketch_would_in_an_eighth_of_its_size(spark):
    """Whole sketches were once broadcast: 64 MB for each in every worker and executor. Batches had 10,000 texts of any size."""
    rng = np.random.default_rng(6)
    hashes = rng.integers(0, 1 << 63, 9000, dtype=np.uint64)[rng.zipf(1.2, 100_000) % 9000]
    sketch = np.zeros((phrases.DEPTH, 1 << 12), np.uint8)
    phrases.add(sketch, hashes, 12)
    for least in (1, 7, 30, 255, 1000):
        marks = phrases.reaching(sketch, least)
        assert marks.nbytes * 8 == sketch.nbytes
        assert (phrases.reach(marks, hashes, 12) == (phrases.estimate(sketch, hashes, 12) >= min(least, phrases.FULL))).all()
    texts = spark.createDataFrame([("a b c " * 40_000, "en")] * 40, "text string, lang string").coalesce(1)
    marks = phrases.marks_of(texts, 3, 16, 30)
    assert marks.shape == (phrases.DEPTH, 1 << 13) and 0 < np.unpackbits(marks).sum() <= phrases.DEPTH * 6
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with phrases.small_batches(spark):
        sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
    assert max(r.n for r in sizes) < 3 << 20 and len(sizes) > 1 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


# -- 12


def brute_search(docs, items, k):
    worded = [(d, Counter(WORD.findall(low(t)))) for d, t in docs if WORD.findall(low(t))]
    n_docs, n_terms = len(worded), sum(sum(c.values()) for _, c in worded)
    df = Counter(t for _, c in worded for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(WORD.findall(low(t)))
    out = set()
    for i, terms in asked.items():
        found = []
        for d, c in worded:
            m = 75 + (25 * sum(c.values()) * n_docs) // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, times in terms.items() if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out |= {(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)}
    return out


def test_search_equals_brute_force(spark, ):
    rng = random.Random(7)
    vocabulary = ["The", "of", "rare1", "é", "中文", "x_y", "A9"] + [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights=[30, 20, 1, 5, 2, 3, 4] + [1] * 40, k=n))
    docs = [(i, text(rng.randint(0, 30))) for i in range(900)] + [(5000, None), (5001, "..."), (5002, "rare1 " * 20_000), (None, "rare1 w1 w2"), (None, "")] + [(6000 + i, "rare1 w3 w4 é") for i in range(30)]
    items = [(i, text(rng.randint(1, 25))) for i in range(20)] + [(100, None), (101, "nowhere_to"), (102, "rare1"), (102, "W3 rare1 é"), (103, ""), (104, "the the the")]
    table = spark.createDataFrame([(*r, 9) for r in docs], "doc_id long, text string, score int").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = brute_search(docs, items, 20)
    for block in (search.BLOCK, 60):
        assert {tuple(r) for r in search.search(table, asked, block=block).collect()} == want
    assert search.search(table.where("false"), asked).count() == 0 and search.search(table, asked.where("false")).count() == 0


def test_wand_skips_documents_that_cannot_win():
    rng = np.random.default_rng(3)
    n = 20_000
    often, rare = np.flatnonzero(rng.random(n) < 0.9), np.sort(rng.choice(n, 60, replace=False))
    row = {"doc_ids": np.arange(n), "sizes": np.full(n, 10), "terms": np.array([1, 2]), "ends": np.array([len(often), len(often) + len(rare)]), "places": np.concatenate([often, rare]), "tf": np.ones(len(often) + len(rare), np.int64)}
    shard, heap = search.Shard(row, n, 10 * n), search.Heap(20)
    scored = search.wand(shard, np.array([1, 2], np.uint64), np.array([100, 6000]), heap)
    both = np.isin(rare, often)
    value = lambda x: 6000 * shard.impact[-1] + 100 * shard.impact[0] * x
    assert sorted(zip((-heap.score).tolist(), heap.ids.tolist(), strict=True)) == sorted((int(-value(b)), int(d)) for d, b in zip(rare, both, strict=True))[:20]
    assert scored < n / 2  # until 20 rare ones are met, every document can win


# -- 13


def brute_host_path(url):
    behind = url.split("://", 1)[1] if url and "://" in url else None
    if behind is None:
        return "", ""
    host = re.match("[^/?#]*", behind)[0]
    return low(host), re.match("[^?#]*", behind[len(host) :])[0]


def brute_model(texts, order):
    """Interpolated probabilities straight from the definition, nothing pruned."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = urls.BEGIN * order + t + urls.END
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[k][s[i - k : i], s[i]] += 1
    sizes, kinds = [Counter() for _ in counts], [Counter() for _ in counts]
    for k, own in enumerate(counts):
        for (context, _), n in own.items():
            sizes[k][context] += n
            kinds[k][context] += 1

    def p(context, c):
        value = urls.UNIFORM
        for k in range(order + 1):
            short = context[len(context) - k :]
            if sizes[k][short]:
                value = (counts[k][short, c] + kinds[k][short] * value) / (sizes[k][short] + kinds[k][short])
        return value

    return p


def test_url_scores_equal_brute_force(spark):
    rng = random.Random(1)
    host = lambda: rng.choice(["a", "News", "shop", "casino"]) + str(rng.randint(1, 9)) + rng.choice([".net", ".org", ".example.net", ".example.com", ".io", ".EXAMPLE.com"])
    made = [f"http{rng.choice(['', 's'])}://{host()}{rng.choice(['/en/', '/de/', '/fr/', '', '/'])}{rng.choice(['', 'x', 'win-big', 'story'])}{rng.choice(['', '?q=1', '#top'])}" for _ in range(600)]
    odd = [None, "", "no scheme/at/all", "http://", "://net/", "http://NET/", "http://net?x=/", "http://xnet/", "http://a.net", "x://y.example.net/en/\n/z", "http://é.中文/fr/\U0001f600", "ftp://q.io/" + "long" * 5000, "http://a.example.net/en"]
    pages = [(i, u, 7) for i, u in enumerate(made + odd)] + [(None, "http://q.io/x", 7), (3, made[3], 7)]
    got = {(r.page_id, r.url): r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, host int").repartition(3)).collect()}
    assert len(got) == len({p[:2] for p in pages})
    verdicts, data = dict(urls.RULES), {}
    for _, u, _ in pages:
        h, p = brute_host_path(u)
        fit = [r for r in verdicts if (h == r.split("/")[0] or h.endswith("." + r.split("/")[0])) and p.startswith("/" + r.split("/", 1)[1])]
        text = u.split("://", 1)[1] if u and "://" in u else u or ""
        data[u] = h, p, max(fit, key=len, default=None), re.sub("[1-9]", "0", low(text))
    import hashlib

    held = lambda t: hashlib.md5(t.encode()).hexdigest()[0] in urls.CALIBRATION
    labelled = {(t, verdicts[r] == "allow") for _, _, r, t in data.values() if r}
    good, bad = (brute_model([t for t, g in labelled if g == want and not held(t)], urls.ORDER) for want in (True, False))

    def score(t):
        s = urls.BEGIN * urls.ORDER + t + urls.END
        each = [math.log(good(s[i - urls.ORDER : i], s[i]) / bad(s[i - urls.ORDER : i], s[i])) for i in range(urls.ORDER, len(s))]
        return 1e6 * sum(each) / len(each)

    tried = sorted((score(t), g) for t, g in labelled if held(t))
    n_good, n_bad = sum(g for _, g in tried), sum(not g for _, g in tried)
    wrong = lambda x: sum(g for s, g in tried if s < x) / n_good + sum(not g for s, g in tried if s >= x) / n_bad
    chosen = urls.threshold(spark.createDataFrame([(int(s), g) for s, g in tried], "score long, good boolean"))
    assert math.isclose(wrong(chosen), min(wrong(urls.STEP * math.floor(s / urls.STEP)) for s, _ in tried), abs_tol=0.02)
    for (_, u), r in got.items():
        h, p, rule, text = data[u]
        assert (r.host, r.path, r.rule) == (h, p, rule), u
        if rule:
            assert r.verdict == verdicts[rule] and r.score is None
        else:
            assert abs(r.score - score(text)) < 8 and r.verdict in ("allow", "block")  # roundings of up to 2 * ORDER + 1 ratios of a position
    split = [(r.score, r.verdict) for r in got.values() if r.rule is None]
    assert max([s for s, v in split if v == "block"], default=-math.inf) < min([s for s, v in split if v == "allow"], default=math.inf)


def test_url_edges(spark):
    frame = spark.createDataFrame([(1, "http://a.io/x"), (2, None)], "page_id long, url string")
    assert {(r.verdict, r.score) for r in urls.judge(frame).collect()} == {("allow", 0)}  # nothing to learn from
    assert urls.judge(frame.where("false")).count() == 0
    with pytest.raises(ValueError):
        urls.judge(frame.withColumnRenamed("url", "host"), url="host")
    hot = spark.createDataFrame([(i, "http://hot.io/page" if i % 3 else f"http://u{i}.example.{'net/en/' if i % 2 else 'com/de/'}{i}") for i in range(300)], "page_id long, url string")
    got = urls.judge(hot)
    assert got.count() == 300 and got.where("url = 'http://hot.io/page'").select("verdict", "score").distinct().count() == 1


def test_rare_character_runs_count(spark):
    """N-grams below 1 / 131,072 of all positions were once left out, and scores beyond 8 were one step of the threshold."""
    import hashlib

    rng = random.Random(3)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    good, bad = ([f"{word(40)}.example.{end}/{word(20)}" for _ in range(1500)] for end in ("net/en", "com/de"))
    good.append("zqxzqx.example.net/en/zqxzqxzqx")
    held = lambda t: hashlib.md5(t.encode()).hexdigest()[0] in urls.CALIBRATION
    while held(good[-1]):
        good[-1] += "a"
    asked = ["zqxzqxzqx.io", "abc.io/zqx"]
    frame = spark.createDataFrame([(i, "http://" + u) for i, u in enumerate(good + bad + asked)], "page_id long, url string")
    got = {r.url.split("://")[1]: r.score for r in urls.judge(frame).where("rule is null").collect()}
    a, b = (brute_model([t for t in side if not held(t)], urls.ORDER) for side in (good, bad))
    for t in asked:
        s = urls.BEGIN * urls.ORDER + t + urls.END
        each = [math.log(a(s[i - urls.ORDER : i], s[i]) / b(s[i - urls.ORDER : i], s[i])) for i in range(urls.ORDER, len(s))]
        assert abs(got[t] - 1e6 * sum(each) / len(each)) < 8
    far = [(9_500_000, True), (9_400_000, False)] * 3
    assert 9_400_000 < urls.threshold(spark.createDataFrame(far, "score long, good boolean")) <= 9_500_000
