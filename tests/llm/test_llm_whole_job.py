"""Inputs on which an operator once did less than its whole job."""

import gzip

import numpy as np

from notelattice.llm import html, licenses, neardup, warc


def test_label_of_long_shuffled_chains(spark):
    rng = np.random.default_rng(3)
    ids = rng.permutation(4000)
    links = [*zip(ids[:2999].tolist(), ids[1:3000].tolist(), strict=True), *zip(ids[3000:3999].tolist(), ids[3001:].tolist(), strict=True)]
    got = {r.node: r.component for r in neardup.label(spark.createDataFrame(links, "a long, b long")).collect()}
    low, high = int(ids[:3000].min()), int(ids[3000:].min())
    assert got == {int(x): low if k < 3000 else high for k, x in enumerate(ids)}


def test_link_text_in_unmarked_pages():
    page = '<html><body><div id="menu"><a href="/">Home</a> <a href="/a">About us</a></div><div id="wrap"><p>Long text, with <a href=x>linked <b>words</b></a> in it. It goes on, and on; it has more to say.</p><p>So<a> </a>it <em>is</em>.</p></div></body></html>'
    assert html.main_text(page) == "Long text, with linked words in it. It goes on, and on; it has more to say.\nSo it is."
    assert html.main_text('<div id="wrap"><p>Long text with <a href=x>linked words</a> in it.</p></div>') == "Long text with linked words in it."


LONG = "This is a long contribution of a reader, with many words, that goes on and on, and on; it has much to say about nothing. " * 3
ARTICLE = "<article><h1>Head</h1><p>A paragraph of the article, with words, and more words in it.</p><p>A second one, of the same kind, and it goes on for some time.</p>%s</article>"


def thread(name, *items):
    return f'<div class="{name}">' + "".join(f"<div class=x>{sign}<p>{LONG}</p></div>" for sign in items) + "</div>"


def test_threads_of_readers_are_known_by_their_form():
    for name in ("discussion", "feedback", "anything"):
        signs = ("<b class=author>Ann</b>", "<b class=author>Bob</b>"), ("<time>1 May</time>", "<time>2 May</time>")
        for pair in signs:
            assert html.main_text(f"<body>{ARTICLE % ''}{thread(name, *pair)}</body>") == html.main_text(f"<body>{ARTICLE % ''}</body>")
            assert LONG.strip() not in html.main_text(f"<body>{ARTICLE % thread(name, *pair)}</body>")
            unmarked = f'<div id="wrap"><div class="story"><p>{"Words of the story, and more. " * 40}</p><p>{"More of the story, it says. " * 50}</p></div>{thread(name, *pair)}</div>'
            assert "contribution" not in html.main_text(unmarked) and html.main_text(unmarked).count("\n") == 1
    alone = f"<body>{thread('posts', '<time>1</time>', '<time>2</time>')}</body>"
    assert html.main_text(alone).count(LONG.strip()) == 2  # a page that is a thread


def test_what_stands_in_an_article_stays():
    text = lambda more: html.main_text(f"<body>{ARTICLE % more}</body>").split("\n")[-1]
    assert text('<p class="recommended">Kept, as it is a paragraph of the article.</p>') == "Kept, as it is a paragraph of the article."
    assert text("<p>See <label>the label</label> here, then.</p>") == "See the label here, then."
    assert text("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds, as said.</p>") == "So x=1 holds, as said."
    assert text('<form><label>Name</label></form><div class="notice">We use cookies.</div><p>The end of it, at last.</p>') == "The end of it, at last."


def test_license_copies_in_other_text_are_found(spark):
    rng = np.random.default_rng(8)
    body = licenses.TEMPLATES["BSD-redistribution"].split()
    copy = " ".join(body[:18])  # 16 of the 19 shingles
    other = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, n))
    rows = [(i, f"{other(64 + i % 128)} {copy} {other(200)}") for i in range(3000)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("template = 'BSD-redistribution'")
    assert found.count() == len(rows)


def test_license_bands_keep_the_bound():
    for longest in (4, 8, 16, 32, 64, 128, 256, 512, 1024):
        for size in range(1 if longest == 4 else longest // 2 + 1, longest + 1):
            assert licenses.class_of(size) == longest
            held = -(-80 * size // 100)
            assert (1 - held / (2 * longest + size - held)) ** licenses.bands_for(size, longest, 80) <= licenses.MISS


def test_warc_members_and_damage(spark, tmp_path):
    def record(k, length=None):
        body = f"body {k} ".encode() * 50
        return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://%d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, len(body) if length is None else length, body)

    members = [gzip.compress(record(k)) for k in range(5)]
    starts = [sum(map(len, members[:k])) for k in range(5)]
    whole = b"".join(members)
    assert [x[:4] for x in warc.parse(whole)] == [(starts[k], len(members[k]), "response", f"http://{k}") for k in range(5)]
    hurt = bytearray(whole)
    hurt[starts[2] + len(members[2]) // 2] ^= 0xFF
    got = list(warc.parse(bytes(hurt)))
    assert [x[:2] for x in got] == [(starts[k], len(members[k])) for k in range(5)]
    assert [x[2] for x in got] == ["response", "response", "unreadable", "response", "response"] and got[2][4] is None
    plain = [record(0), record(1, 7), record(2).replace(b"WARC/1.0", b"WORC/1.0"), record(3)]
    got = list(warc.parse(b"".join(plain)))
    assert [(x[0], x[2], x[3]) for x in got] == [(0, "response", "http://0"), (len(plain[0]), "unreadable", ""), (len(b"".join(plain[:3])), "response", "http://3")]
    assert sum(x[1] for x in got) == len(b"".join(plain))
    assert [x[2] for x in warc.parse(whole[:-3])] == ["response"] * 4 + ["unreadable"] and list(warc.parse(b"junk")) == [(0, 4, "unreadable", "", None)]
    digests = []
    for k, data in enumerate((whole, bytes(hurt), b"".join(plain), b"".join(plain).replace(b"http://3", b"http://4"))):
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}" / "a").write_bytes(data)
        digests.append({r.offset: r.digest for r in warc.read_warc(spark, str(tmp_path / f"{k}")).collect()})
    assert [o for o in digests[0] if digests[0][o] != digests[1][o]] == [starts[2]]
    assert [o for o in digests[2] if digests[2][o] != digests[3][o]] == [len(b"".join(plain[:3]))]
