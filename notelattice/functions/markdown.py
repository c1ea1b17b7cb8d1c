"""The note grammar: frontmatter, observations, relations and wikilinks of markdown notes, and the UDF that reads them.

The grammar needs nesting-aware links and balanced parentheses, so it is Python over Arrow batches; one pass gives a note's
whole structure, and everything after that is relational.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices, text_sizes

try:
    import yaml
except ImportError:  # said by load_yaml, when there is frontmatter to read
    yaml = None

MARKERS = ("- ", "* ", "+ ")
DIRECTIVE = "#bm:links_to"
FENCE = re.compile(r"\s*(?:```|~~~)")
TIMECODE = re.compile(r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?")


# -- frontmatter


def split_frontmatter(text: str) -> tuple[str | None, str]:
    """The YAML between a leading --- and a line --- or ..., and what follows; no YAML if it is not closed."""
    if not text.startswith("---\n"):
        return None, text
    lines = text.split("\n")
    for i in range(1, len(lines)):
        if lines[i].rstrip() in ("---", "..."):
            return "\n".join(lines[1:i]), "\n".join(lines[i + 1 :])
    return None, text


def load_yaml(text: str) -> dict:
    """The mapping of a YAML text, {} for an empty one or one that is no mapping; ValueError if it is malformed.

    One library reads all frontmatter, on the driver and in tasks. Plain scalars are null, true and false, numbers and text,
    nothing else (a date is text); tags of other kinds are taken off, keys become text, and a key that is given twice is an
    error. Aliases may not blow a note up to more than a hundred values for each character.
    """
    if yaml is None:
        raise ModuleNotFoundError("frontmatter is read by PyYAML, which is not installed")
    try:
        node = yaml.compose(text, _loader())
    except (yaml.YAMLError, RecursionError) as e:
        raise ValueError(" ".join(str(e).split())) from e
    found = None if node is None else _value(node, [100 * len(text) + 1000], ())
    return found if isinstance(found, dict) else {}


# What plain scalars are resolved to, and by which first characters.
RESOLVED = (
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("int", r"^[-+]?(?:0|[1-9][0-9]*)$", "-+0123456789"),
    ("float", r"^[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(?:\.[0-9]*)?[eE][-+]?[0-9]+)$", "-+.0123456789"),
)
_LOADERS: list = []


def _loader():
    if not _LOADERS:

        class Plain(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
            yaml_implicit_resolvers = {}

        for name, pattern, first in RESOLVED:
            Plain.add_implicit_resolver(f"tag:yaml.org,2002:{name}", re.compile(pattern), list(first))
        _LOADERS.append(Plain)
    return _LOADERS[0]


def _value(node, room: list[int], above: tuple):
    """A node of the parsed text as a value; room counts down, above are the nodes that hold this one."""
    room[0] -= 1
    if room[0] < 0 or any(node is x for x in above) or len(above) > 200:
        raise ValueError("aliases or nesting without end")
    inner = (*above, node)
    if isinstance(node, yaml.SequenceNode):
        return [_value(x, room, inner) for x in node.value]
    if isinstance(node, yaml.MappingNode):
        out: dict = {}
        for k, v in node.value:
            key = k.value if isinstance(k, yaml.ScalarNode) else flat(as_text(_value(k, room, inner)))
            if key in out:
                raise ValueError(f"duplicate key {key!r}")
            out[key] = _value(v, room, inner)
        return out
    kind, text = node.tag.rsplit(":", 1)[-1], node.value
    if kind == "null":
        return None
    if kind == "bool":
        return text.lower() == "true"
    try:
        return int(text) if kind == "int" else float(text) if kind == "float" else text
    except ValueError:
        return text


def as_text(value):
    """Frontmatter scalars become strings: True, 3, 1.5; lists and mappings keep their form, null stays null."""
    if isinstance(value, bool):
        return "True" if value else "False"
    if isinstance(value, list):
        return [as_text(v) for v in value]
    if isinstance(value, dict):
        return {str(k): as_text(v) for k, v in value.items()}
    return value if value is None else str(value)


def flat(value) -> str:
    """One string for any value: lists are joined by commas, null is empty."""
    if value is None:
        return ""
    return ", ".join(flat(v) for v in value) if isinstance(value, list) else str(value)


def parse_tags(value) -> list[str]:
    """Tags of a list, a JSON array in a string, or a comma-separated string; leading # and blanks go."""
    if value is None:
        return []
    if isinstance(value, str):
        if value.strip().startswith("["):
            try:
                return parse_tags(json.loads(value))
            except ValueError:
                pass
        value = value.split(",")
    items = value if isinstance(value, list) else [value]
    return [t for t in (flat(v).strip().lstrip("#").strip() for v in items) if t]


# -- lines


def _lines(body: str) -> Iterator[str]:
    """Lines outside fenced code."""
    fenced = False
    for line in body.split("\n"):
        if FENCE.match(line):
            fenced = not fenced
        elif not fenced:
            yield line


def _unmarked(line: str) -> tuple[str, bool]:
    text = line.strip()
    for m in MARKERS:
        if text.startswith(m):
            return text[len(m) :].strip(), True
    return text, False


def observation(line: str) -> dict | None:
    """The observation of a line, if it is one: - [category] content #tag (context)."""
    text = line.strip()
    if text.startswith((">", "#")) and not text.startswith("#bm") and re.match(r">|#+\s", text):
        return None
    text, _ = _unmarked(line)
    if text.endswith(DIRECTIVE):
        text = text[: -len(DIRECTIVE)].rstrip()
    if not text or text.startswith(("[ ]", "[x]", "[-]")) or re.match(r"\[[^\[\]]*\]\([^)]*\)", text):
        return None
    if text.startswith("[[") and text.endswith("]]") and "[[" not in text[2:]:
        return None
    category = None
    m = re.match(r"\[([^\[\]()]+)\]\s+(.*)", text, re.S)
    if m and m[1].strip() and not TIMECODE.fullmatch(m[1].strip()) and not (len(m[1]) == 1 and (m[1] in "xX" or not m[1].isalnum())):
        category, text = m[1].strip(), m[2].strip()
    elif text.startswith("[] "):
        text = text[3:].strip()
    if category is None and not any(w.startswith("#") for w in text.split()):
        return None
    context = None
    if text.endswith(")") and "(" in text:
        head, _, tail = text[:-1].rpartition("(")
        context, text = tail.strip(), head.strip()
    tags = [t for w in text.split() if w.startswith("#") for t in w.split("#") if t]
    return {"category": category, "content": text, "context": context or None, "tags": tags}


def observations(body: str) -> list[dict]:
    return [o for line in _lines(body) if (o := observation(line))]


def wikilinks(text: str) -> list[tuple[int, int, str]]:
    """(start, end, inside) of the outermost [[...]] of a text."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(text) - 1:
        pair = text[i : i + 2]
        if pair == "[[":
            if depth == 0:
                start = i
            depth += 1
            i += 2
        elif pair == "]]" and depth:
            depth -= 1
            i += 2
            if depth == 0:
                out.append((start, i, text[start + 2 : i - 2]))
        else:
            i += 1
    return out


def link_parts(inside: str) -> dict:
    target, bar, label = inside.partition("|")
    return {"raw_target": inside, "target": re.sub(r"^([^/:]+)::", r"\1/", target.strip()), "label": label.strip() if bar else None}


def _balanced(text: str) -> bool:
    depth = 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth < 0 or (depth == 0 and i < len(text) - 1):
            return False
    return depth == 0


def relations_of(line: str) -> list[dict]:
    """The relations of a line: an explicit one in a list, else links_to for each link."""
    text, listed = _unmarked(line)
    if not listed:
        text = text.lstrip("#>").strip()
    forced = text.endswith(DIRECTIVE)
    if forced:
        text = text[: -len(DIRECTIVE)].rstrip()
    links = [(a, b, s) for a, b, s in wikilinks(text) if s.strip()]
    if listed and not forced and links:
        a, b, inside = links[0]
        kind, after = text[:a].strip(), text[b:].strip()
        quoted = len(kind) > 2 and kind[0] in "\"'" and kind[-1] == kind[0]
        name = kind[1:-1].strip() if quoted else kind
        whole = after == "" or (after.startswith("(") and after.endswith(")") and _balanced(after))
        if name and (quoted or len(name.split()) == 1) and whole:
            return [{"relation_type": name, "to_name": link_parts(inside)["target"], "context": after[1:-1].strip() or None if after else None}]
    return [{"relation_type": "links_to", "to_name": link_parts(s)["target"], "context": None} for _, _, s in links]


def relations(body: str) -> list[dict]:
    return [r for line in _lines(body) for r in relations_of(line)]


# -- notes

NOTE = T.StructType(
    [
        T.StructField("title", T.StringType()), T.StructField("note_type", T.StringType()), T.StructField("permalink", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.StringType()), T.StructField("body", T.StringType()), T.StructField("error", T.StringType()),
        T.StructField("observations", T.ArrayType(T.StructType([T.StructField("category", T.StringType()), T.StructField("content", T.StringType()), T.StructField("context", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))]))),
        T.StructField("relations", T.ArrayType(T.StructType([T.StructField("relation_type", T.StringType()), T.StructField("to_name", T.StringType()), T.StructField("context", T.StringType())]))),
        T.StructField("wikilinks", T.ArrayType(T.StructType([T.StructField("raw_target", T.StringType()), T.StructField("target", T.StringType()), T.StructField("label", T.StringType())]))),
    ]
)


def instant(text: str) -> str | None:
    """An ISO date or date and time in a form that tells it is one; None if it is none."""
    try:
        found = datetime.fromisoformat(text.strip())
    except ValueError:
        return None
    return found.replace(tzinfo=found.tzinfo or UTC).astimezone(UTC).isoformat()


def instant_of(text: Column) -> Column:
    """A valid frontmatter instant as one that casts to a timestamp: a bare date is midnight; without a zone it is local, in the session's zone."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00"))).otherwise(text)


def parse_note(path: str, text: str) -> dict:
    """A note as a row of NOTE. error says why it can't be indexed: malformed frontmatter or an invalid permalink."""
    text = text.replace("\r\n", "\n").replace("﻿", "")
    head, body = split_frontmatter(text)
    error, meta = None, {}
    if head is None:
        body = text.strip()
    else:
        try:
            meta, body = as_text(load_yaml(head)), body.strip()
        except ValueError as e:
            error, body = f"frontmatter: {str(e).splitlines()[0] if str(e) else 'malformed'}", text
    stem = path.rsplit("/", 1)[-1]
    stem = stem[:-3] if stem.endswith(".md") else stem
    title = flat(meta.get("title"))
    link = flat(meta.get("permalink")) or None
    if link is not None and ("//" in link or re.search(r'[\s<>"|?]', link)):
        error = error or "permalink: invalid"
    for name in ("created", "modified"):
        if flat(meta.get(name)) and instant(flat(meta[name])) is None:
            error = error or f"{name}: invalid timestamp"
    tags = parse_tags(meta.get("tags"))
    if "tags" in meta:
        meta["tags"] = tags
    links = [link_parts(s) for line in _lines(body) for _, _, s in wikilinks(line) if s.strip()]
    return {"title": stem if title in ("", "None") else title, "note_type": flat(meta.get("type")) or "note", "permalink": link, "tags": tags, "metadata": json.dumps(meta, ensure_ascii=False, default=str), "body": body, "error": error, "observations": observations(body), "relations": relations(body), "wikilinks": links}


def _parsed(batches: Iterator[pa.RecordBatch], path: int, text: int) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(NOTE)
    for part in slices(batches, text_sizes(text)):
        rows = [parse_note(p or "", t or "") for p, t in zip(part.column(path).to_pylist(), part.column(text).to_pylist(), strict=True)]
        parsed = pa.array(rows, kind)
        yield pa.RecordBatch.from_arrays([*part.columns, *parsed.flatten()], [*part.schema.names, *NOTE.names])
        del part, rows, parsed


def parse_notes(files: DataFrame, path: str = "file_path", text: str = "text") -> DataFrame:
    """files with the columns of NOTE; a null text is an empty note."""
    files = files.drop(*[f.name for f in NOTE.fields if f.name in files.columns and f.name not in (path, text)])
    at = files.columns.index(path), files.columns.index(text)
    return files.mapInArrow(lambda batches: _parsed(batches, *at), T.StructType([*files.schema.fields, *NOTE.fields]))
