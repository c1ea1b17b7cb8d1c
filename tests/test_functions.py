"""Parsers and scalar functions on small cases."""

from datetime import UTC, datetime

import pytest
import yaml
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notelattice.functions import chunking, dates, edits, markdown
from notelattice.functions import text as T
from notelattice.operators import fulltext, schema

NOTE = """---
title: Harvest log
type: note
tags:
- demo
flag: true
n: 3
---

# Head

- [decision] Press the late apples first
- [fact] Yield was nine crates (weighed) #a#b
- Nothing but a loose #tag
- [] brackets without a name
- [01:02:03] spoken words
- [ ] prune
- [x] mow
- [map](https://orchard.example) of the orchard
> - [aside] said by another

```
- [fact] inside a fence
```
- depends_on [[projects/alpha]]
- "implemented by" [[people/ada]] (primary (really))
- relates_to [[a]] and [[b|B]]
Prose with [[c::d|label]] here.
"""


def test_parse_note():
    n = markdown.parse_note("notes/x.md", NOTE)
    assert (n["title"], n["note_type"], n["tags"], n["error"]) == ("Harvest log", "note", ["demo"], None)
    assert '"flag": "True"' in n["metadata"] and '"n": "3"' in n["metadata"]
    assert [(o["category"], o["content"]) for o in n["observations"]] == [("decision", "Press the late apples first"), ("fact", "Yield was nine crates (weighed) #a#b"), (None, "Nothing but a loose #tag")]
    assert n["observations"][1]["tags"] == ["a", "b"]
    assert [(r["relation_type"], r["to_name"], r["context"]) for r in n["relations"]] == [("depends_on", "projects/alpha", None), ("implemented by", "people/ada", "primary (really)"), ("links_to", "a", None), ("links_to", "b", None), ("links_to", "c/d", None)]


@pytest.mark.parametrize("text, error", [("", None), ("plain", None), ("---\na: [1\n---\nbody", "frontmatter"), ("---\npermalink: a b\n---\n", "permalink"), ("---\nunclosed: 1\n", None)])
def test_parse_note_edges(text, error):
    n = markdown.parse_note("d/stem.md", text)
    assert n["title"] == "stem" and n["note_type"] == "note" and (n["error"] or "").split(":")[0] == (error or "")


def test_parse_notes_frame(spark):
    rows = markdown.parse_notes(spark.createDataFrame([("a.md", NOTE), ("b.md", None)], "file_path string, text string")).orderBy("file_path").collect()
    assert len(rows[0].relations) == 5 and rows[1].title == "b" and rows[1].observations == []


PERMALINKS = {"Notes/My File.md": "notes/my-file", "a_b  c.txt": "a-b-c", "中文Test.md": "中文-test", "Ünï.md": "n", "a/-b-/c.": "a/b/c.", "x.tar.gz": "x.tar.gz", "--.md": "", "A\\B.MD": "a/b", "v1.2 中 x": "v1.2-中-x"}


def test_permalink(spark):
    got = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in PERMALINKS], "p string").select("p", T.permalink(F.col("p"))).collect()}
    assert got == PERMALINKS


def test_note_type_and_variants(spark):
    row = spark.range(1).select(T.note_type(F.lit("FieldReport")), T.note_type(F.lit(" Memory Service-x.y\\z ")), T.variants(F.lit("A b/C")), T.tokens(F.lit("Été 2/x_y ñandú"))).first()
    assert list(row) == ["field_report", "memory_service_x_y_z", ["A b", "A b/C", "C", "a", "a b/c", "b/c"], ["ete", "2", "x", "y", "nandu"]]


def test_globs():
    import re

    match = lambda g, s: bool(re.match(T.glob_to_regex(g), s))
    assert match("a*[!x]?", "abcd") and not match("a[xy]", "az") and match("a[b", "a[b") and match("*.md", "q.md") and not match("*.md", "qxmd")
    with pytest.raises(ValueError):
        T.glob_to_regex("a[b", strict=True)


def test_chunks():
    assert chunking.split("") == [] and chunking.split("# A\nx\n\n# B\ny") == ["# A\nx\n\n# B\ny"]
    assert chunking.split("intro\n- one\n- two\nend") == ["intro", "- one", "- two\nend"]
    long = "w" * 2500
    assert [len(c) for c in chunking.split(long)] == [900, 900, 900, 160] and "".join(chunking.split(long)[:1]) == long[:900]
    assert all(len(c) <= 900 for c in chunking.split("\n\n".join("p" * 500 for _ in range(9))))


def test_windows_equal_python_cut(spark):
    texts = ["", "a", "b" * 900, "c" * 901, "d" * 1020, "e" * 1021, "f" * 2500]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(chunking.windows(F.col("t")).alias("w")).collect()
    assert [[len(x) for x in r.w] for r in got] == [[len(c) for c in chunking._cut(t)] for t in texts]


def test_dates():
    now = datetime(2024, 3, 31, 12, tzinfo=UTC)
    assert dates.normalize_timeframe("2 weeks", now) == "14d" and dates.normalize_timeframe("Today", now) == "today" and dates.normalize_timeframe("36h", now) == "2d"
    assert dates.parse_timeframe("1h", now) == dates.parse_timeframe("today", now) == datetime(2024, 3, 30, 12, tzinfo=UTC)
    assert dates.parse_after_date("1 month ago", now).date().isoformat() == "2024-02-29" and dates.parse_after_date("soon", now) is None
    for bad in ("2 years", "x", "2999-01-01T00:00:00+00:00"):
        with pytest.raises(ValueError):
            dates.normalize_timeframe(bad, now)


def test_query_preparation():
    p = fulltext.prepare
    assert p("rust") == "rust*" and p("rust index") == "rust* AND index*" and p("a-b") == '"a-b"*' and p("notes/a.md") == '"notes/a.md"' and p("sea*") == "sea*"
    assert p("a and (b or c)") == '"a and (b or c)"*' and p("a AND b") == "a* AND b*" and p("  ") is None
    assert fulltext.relaxed("how is the graph stored") == "graph* OR stored*" and fulltext.relaxed("a b") is None and fulltext.relaxed('x y "z"') is None
    for bad in ("(a AND b", "AND", "a OR"):
        with pytest.raises(ValueError):
            fulltext.parse(bad)


def test_edits():
    doc = "# T\n\n## A\nold\n### sub\ns\n```\n## A\n```\n## B\nb\n"
    assert edits.edit(doc, "replace_section", "new", section="A") == "# T\n\n## A\nnew\n## B\nb\n"
    assert "### sub" in edits.edit(doc, "replace_section", "new", section="## A", replace_subsections=False)
    assert edits.edit("x", "append", "y") == "x\ny" and edits.edit("x", "prepend", "y") == "y\nx" and edits.edit("a a", "find_replace", "b", find_text="a", expected=2) == "b b"
    assert edits.edit("---\ntitle: T\n---\nbody", "prepend", "top") == "---\ntitle: T\n---\n\ntop\nbody"
    assert edits.edit(doc, "insert_before_section", "mid", section="B").count("mid\n\n## B") == 1
    for case in ({"operation": "find_replace", "find_text": "zz"}, {"operation": "insert_after_section", "section": "Q"}, {"operation": "nope"}):
        with pytest.raises(ValueError):
            edits.edit(doc, content="", **case)


@pytest.mark.parametrize("value", ["true", "3", "a: b", "- x", "plain words", " lead", "2024-01-01", "it's", "", "#tag", "null"])
def test_frontmatter_round_trip(value):
    text = edits.render({"title": "T", "v": value, "tags": ["a", "1"]}, "body")
    head, body = markdown.split_frontmatter(text)
    assert markdown.load_yaml(head) == {"title": "T", "v": value, "tags": ["a", "1"]} and body.strip() == "body"


def test_schema_fields():
    entity, fields, mode = schema.parse_schema({"entity": "Person", "schema": {"name": "string, full name", "role?": "string", "works_at?": "Organization", "status?(enum)": ["active", "gone"], "mail(array)": "string"}, "settings": {"validation": "error"}})
    assert (entity, mode) == ("Person", "strict")
    assert [(f.name, f.required, f.is_array, f.is_enum, f.is_reference) for f in fields] == [("name", True, False, False, False), ("role", False, False, False, False), ("works_at", False, False, False, True), ("status", False, False, True, False), ("mail", True, True, False, False)]
    with pytest.raises(ValueError):
        schema.parse_schema({"schema": {}})


def test_yaml_of_notes():
    text = """# comment
title: "A: b"   # said
schema:
  name: string
  kind(enum): [a, 'b, c', 3]
  deep:
    x: 1.5
list:
- one
- two: 2
  three: yes it is
flow: {a: 1, b: [x, y]}
text: |
  line one
    line two
empty:
last: 'it''s'
"""
    assert markdown.load_yaml(text) == {"title": "A: b", "schema": {"name": "string", "kind(enum)": ["a", "b, c", 3], "deep": {"x": 1.5}}, "list": ["one", {"two": 2, "three": "yes it is"}], "flow": {"a": 1, "b": ["x", "y"]}, "text": "line one\n  line two\n", "empty": None, "last": "it's"}
    assert markdown.load_yaml("") == {} and markdown.load_yaml("a:\n- 1\n- 2") == {"a": [1, 2]}
    for bad in ("a: [1", "a: 'b", "a: 1\n   b: 2", "a: 1\na: 2", "x: &a [*a]", "a: b\n---\nc: d"):
        with pytest.raises(ValueError):
            markdown.load_yaml(bad)
    assert markdown.load_yaml("- x") == markdown.load_yaml("plain") == {}


def test_yaml_beyond_the_simple():
    read = markdown.load_yaml
    assert read("a: one\n  two") == {"a": "one two"} and read("a: [x,\n  y]") == {"a": ["x", "y"]} and read("? k") == {"k": None}
    assert read("a: &x 1\nb: *x") == {"a": 1, "b": 1} and read("a: !!str 5\nb: !own 5\nc: !own [1]") == {"a": "5", "b": "5", "c": [1]}
    assert read("a: 2024-01-01\nb: yes\nc: 007\nd: 1.50\n5: x\n? [p, q]\n: r") == {"a": "2024-01-01", "b": "yes", "c": "007", "d": 1.5, "5": "x", "p, q": "r"}
    bomb = "a: &a [x, x, x, x, x, x, x, x, x]\n" + "".join(f"{c}: &{c} [{', '.join(['*' + chr(ord(c) - 1)] * 9)}]\n" for c in "bcdefgh")
    with pytest.raises(ValueError):
        read(bomb)
    assert markdown.parse_note("n.md", "---\n- a\n---\nbody")["body"] == "body"


@given(st.dictionaries(st.text(st.characters(codec="utf-8", exclude_categories=["Cc", "Cs", "Zl", "Zp"]), min_size=1, max_size=8), st.recursive(st.none() | st.booleans() | st.integers() | st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=12), lambda x: st.lists(x, max_size=3), max_leaves=5), max_size=4))
@settings(max_examples=60, deadline=None)
def test_yaml_reads_what_the_library_writes(mapping):
    assert markdown.load_yaml(yaml.safe_dump(mapping, allow_unicode=True)) == mapping


@pytest.mark.parametrize("head, error", [("permalink: /a", None), ("permalink: a//b", "permalink"), ("permalink: a|b", "permalink"), ("created: 2024-02-30", "created"), ("created: 2024-02-29", None), ("modified: 2024-01-01T10:00:00+02:00", None), ("modified: soon", "modified")])
def test_frontmatter_values(head, error):
    found = markdown.parse_note("x.md", f"---\n{head}\n---\nbody")["error"]
    assert (found or "").split(":")[0] == (error or "")


def test_relaxation_of_marks_joiners_and_formats():
    tokens = fulltext.word_tokens
    assert tokens("don't stop, l\u2019eau 'quoted' a.b x-y") == ["don't", "stop", "l\u2019eau", "quoted", "a", "b", "x", "y"]
    assert tokens("हिन्दी भाषा e\u0301t") == ["हिन्दी", "भाषा", "e\u0301t"] and tokens("\u0301a \u200db 1'2") == ["a", "b", "1", "2"]
    assert tokens("foo\u00adbar one\u200btwo end\u200d") == ["foo\u00adbar", "one", "two", "end"]
    assert fulltext.relaxed("foo\u00adbar wide river") == "foobar* OR foo\u00adbar* OR wide* OR river*"
    assert fulltext.relaxed("river River wide") == "river* OR wide*" and fulltext.relaxed("the don't river's edge") == '"don\'t"* OR "river\'s"* OR edge*'
    assert fulltext.relaxed("one two 3") is None and fulltext.relaxed("what is the") == "what* OR is* OR the*"
    assert fulltext.relaxed("zzzz-not-present") == "zzzz* OR not* OR present*" and fulltext.relaxed("the 東京") is None
    assert fulltext.relaxed("東京、 大阪。") == "東京* OR 大阪*" and fulltext.relaxed("東京 2024") is None and fulltext.relaxed("三 大阪") == "三* OR 大阪*"


def test_relaxation_of_unspaced_scripts():
    assert fulltext.relaxed("한국 문서") == "한국* OR 문서*" and fulltext.relaxed("two words") is None
