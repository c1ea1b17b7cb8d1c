"""Text functions as column expressions: permalinks, note types, search text, tokens, identities."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions that a permalink drops, and the code points that count as CJK.
EXTENSIONS = "md markdown mdx txt json yaml yml toml csv png jpg jpeg gif svg pdf"
CJK = "\\x{3000}-\\x{303f}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{ff00}-\\x{ffef}"
STEMS_CHARS = 6000
SNIPPET_CHARS = 4000

_UPPER = "".join(map(chr, range(65, 91)))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def permalink(path: Column) -> Column:
    """The permalink of a file path: ASCII lower case, hyphens for blanks and at CJK borders, other characters dropped."""
    c = F.translate(path, "\\", "/")
    c = F.regexp_replace(c, rf"(?is)\.({EXTENSIONS.replace(' ', '|')})$", "")
    c = F.regexp_replace(c, rf"[^{CJK}A-Za-z0-9/.\-_\p{{IsWhite_Space}}]", "")
    c = F.regexp_replace(c, r"[_\p{IsWhite_Space}]+", "-")
    c = F.regexp_replace(c, rf"(?<=[{CJK}])(?=[^{CJK}\-])|(?<=[^{CJK}\-])(?=[{CJK}])", "-")
    c = F.regexp_replace(ascii_lower(c), "-+", "-")
    c = F.regexp_replace(F.regexp_replace(c, "-*/-*", "/"), "^-+|-+$", "")
    return F.regexp_replace(c, "^/+|/+$", "")


def note_type(name: Column) -> Column:
    """A note type in snake case: blanks, hyphens, backslashes and dots separate, and so do lower-to-upper borders."""
    c = F.regexp_replace(name, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")
    c = F.regexp_replace(c, r"[\p{IsWhite_Space}\-\\.]", "_")
    return F.lower(F.regexp_replace(c, "([a-z0-9])(?=[A-Z])", "$1_"))


def variants(text: Column) -> Column:
    """The sorted distinct search forms of a text: itself, in lower case, its path parts, its lower-case words."""
    parts = F.when(F.contains(text, F.lit("/")), F.filter(F.transform(F.split(text, "/"), lambda p: F.trim(p)), lambda p: p != "")).otherwise(F.array().cast("array<string>"))
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.concat(F.array(text, F.lower(text)), parts, words)))


def join_variants(*parts: Column) -> Column:
    """Arrays of search forms joined by line feeds, blank ones dropped, cut to STEMS_CHARS characters."""
    return F.substring(F.array_join(F.filter(F.concat(*parts), lambda p: F.trim(p) != ""), "\n"), 1, STEMS_CHARS)


def _folding() -> tuple[str, str]:
    """Letters whose canonical decomposition is a base letter and marks, and those base letters, by rule."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isalpha() and all(unicodedata.combining(x) for x in base[1:]) and chr(code).lower() == chr(code):
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _BASE = _folding()


def tokens(text: Column) -> Column:
    """Runs of letters, digits and private-use characters, lower-cased, without diacritics; everything else separates."""
    folded = F.regexp_replace(F.translate(F.lower(text), _MARKED, _BASE), r"\p{M}+", "")
    return F.filter(F.split(F.coalesce(folded, F.lit("")), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def external_id(key: Column) -> Column:
    """A version 4 shaped UUID of the first 16 bytes of the key's SHA-256."""
    h = F.sha2(key, 256)
    variant = F.element_at(F.split(F.lit("8,9,a,b"), ","), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def observation_permalink(note: Column, category: Column, content: Column) -> Column:
    """The permalink of an observation; long contents are cut to 200 characters and told apart by a digest."""
    short = F.when(F.length(content) > 200, F.concat(F.substring(content, 1, 200), F.lit("-"), F.substring(F.sha2(content, 256), 1, 12))).otherwise(content)
    return permalink(F.concat_ws("/", note, F.lit("observations"), category, short))


def relation_permalink(source: Column, kind: Column, target: Column) -> Column:
    return F.when(source.isNotNull(), permalink(F.concat_ws("/", source, kind, target)))


def glob_to_regex(glob: str, strict: bool = False) -> str:
    """A regular expression for a whole string. strict: an unclosed bracket is an error instead of a plain character."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            j = i + 1
            if j < len(glob) and glob[j] in "!^":
                j += 1
            if j < len(glob) and glob[j] == "]":
                j += 1
            while j < len(glob) and glob[j] != "]":
                j += 1
            if j >= len(glob):
                if strict:
                    raise ValueError(f"unclosed bracket in {glob!r}")
                out += r"\["
            else:
                body = glob[i + 1 : j].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&\\&")
                out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
                i = j
        else:
            out += "\\" + c if c in r"\.^$+{}()|]" else c
        i += 1
    return f"(?s)^(?:{out})$"


def ascii_lower(text: Column) -> Column:
    """A to Z folded, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
