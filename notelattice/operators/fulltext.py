"""Full-text search: query preparation, matching within one column, BM25 of the first matching column, relaxation.

Rows have four token columns (title, content_stems, content_snippet, permalink). A row matches if the whole expression
holds within one of the first three; its leg is the first of them that does. For each phrase q of the query
    score = -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * D / avgD))),   idf = ln((N - n + 0.5) / (n + 0.5)) or 1e-6
with f the occurrences in the leg's column, n the rows whose leg column has q, D the row's tokens over all four columns,
and N and avgD over the whole table, whatever the filters. Lower is better.

An index is written once: postings (term, column, row, positions) in runs sorted by term, so that a query reads the pages of
its own terms only (pushed-down comparisons and prefixes), the size of each row, and one row of table-wide statistics. A phrase
joins the positions of its words, shifted, by row and column; what a query costs follows from how often its terms occur, not
from the size of the corpus. `match` does the same by one scan of token columns, for rows that have no index.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.batches import list_sizes, slices

INDEXED = ("title", "content_stems", "content_snippet", "permalink")
LEGS = INDEXED[:3]
RUN = 1 << 20  # tokens that are gathered at once
PAGE_ROWS = 4096
K1, B = 1.2, 0.75

# Characters that make a term a phrase.
PROBLEMATIC = "\"'()[]{}+!@#$%^&=|\\~`"
QUOTING = " .:;,<>?/-"


# -- query preparation


def prepare_term(term: str, prefix: bool = True) -> str:
    """One user term as an expression: words joined by AND, or a quoted phrase if there are special characters."""
    words = term.split()
    if len(words) == 1 and "*" in words[0] and re.fullmatch(r"[\w*-]+", words[0]):
        return words[0]  # a pattern of the user's own
    if len(words) > 1:
        words = [w for w in (w.strip("?!.,;:") for w in words) if w]
    text, star = " ".join(words), "*" if prefix else ""
    if not set(text) & set(PROBLEMATIC + QUOTING) - {" "}:
        return " AND ".join(w + star for w in words)
    is_file = text.endswith(".md") and "/" in text
    return '"' + text.replace('"', '""') + '"' + ("" if is_file else star)


def has_operators(query: str) -> bool:
    return any(f" {op} " in f" {query} " for op in ("AND", "OR", "NOT"))


def prepare(query: str) -> str | None:
    """A user query as an expression, None if nothing is left of it."""
    query = query.strip()
    if not query:
        return None
    if not has_operators(query):
        return prepare_term(query) or None
    out = []
    for token in query.split():
        if token.upper() in ("AND", "OR", "NOT"):
            out.append(token.upper())
        else:
            out.append("(" * token.startswith("(") + prepare_term(token.strip("()")) + ")" * token.endswith(")"))
    return " ".join(out)


def prepare_title(query: str) -> str | None:
    return prepare_term(query, prefix=False) or None


# Words that a relaxed query leaves out.
STOPWORDS = frozenset("a an and are as at be but by did do does for from had has have how i in is it of on or our that the their they this to was we were what when where which who whom whose why will with you your".split())


# Ranges of the scripts that are written without spaces, and of Hangul.
UNSPACED = ((0x1100, 0x11FF), (0x3040, 0x30FF), (0x3130, 0x318F), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA960, 0xA97F), (0xAC00, 0xD7AF), (0xD7B0, 0xD7FF), (0xF900, 0xFAFF), (0xFF65, 0xFF9F))


# Punctuation at the edges of words, inside words, joiners that belong to the spelling, and the one format
# character that separates words.
EDGE = "?!.,;:，。！？；：、"
INSIDE = "'\u2018\u2019\uff07\u00b7\u0387\u055f\u05f3\u05f4"
JOINERS = "\u200c\u200d"
SEPARATOR = "\u200b"


def _is_format(c: str) -> bool:
    """An invisible character inside a word, which may be stored or not."""
    return unicodedata.category(c) == "Cf" and c != SEPARATOR


def _hangs(c: str) -> bool:
    return _is_format(c) or unicodedata.category(c)[0] == "M"


def _is_alnum(c: str) -> bool:
    return c.isalpha() or unicodedata.category(c)[0] == "N"


def word_tokens(text: str) -> list[str]:
    """Runs of letters and digits with the marks, joiners and inner apostrophes that are written in them."""
    kinds = ["w" if _is_alnum(c) else "h" if _hangs(c) else "i" if c in INSIDE else " " for c in text]
    bare = [k for k, kind in enumerate(kinds) if kind != "h"]  # what stands beside a character, past what hangs off it
    beside = {k: (bare[n - 1] if n else None, bare[n + 1] if n + 1 < len(bare) else None) for n, k in enumerate(bare)}
    for k in bare:
        if kinds[k] == "i":
            before, after = beside[k]
            kinds[k] = "h" if before is not None and after is not None and text[before].isalpha() and text[after].isalpha() else " "
    found = [text[m.start() : m.end()] for m in re.finditer("w[wh]*", "".join(kinds))]
    return [w for w in (_without_end(w) for w in found) if w]


def _without_end(word: str) -> str:
    while word and _is_format(word[-1]):
        word = word[:-1]
    return word


def _is_number(word: str) -> bool:
    core = [c for c in word if not _hangs(c)]
    return bool(core) and all(unicodedata.category(c)[0] == "N" for c in core)


def _forms(words: list[str]) -> list[str]:
    """Each word without its format characters, and as it is if it has any; each form once, whatever its case."""
    out: dict[str, str] = {}
    for word in words:
        clean = "".join(c for c in word if c in JOINERS or not _is_format(c))
        for form in ([clean] if clean == word else [clean, word]) if clean else []:
            out.setdefault(form.lower(), form)
    return list(out.values())


def relaxed_words(query: str) -> list[str] | None:
    """The words that a relaxed query asks for; None if it must not be relaxed: quotes, operators, numbers, or too few words.

    If there are words of a script that is written without spaces, words are what stands between blanks, those with anything
    but letters and digits go, and two are enough and must be left; otherwise three are asked for."""
    query = query.strip()
    if not query or '"' in query or has_operators(query):
        return None
    words = [w for w in (w.strip(EDGE) for w in query.split()) if w]
    unspaced = lambda w: any(a <= ord(c) <= b for c in w for a, b in UNSPACED)
    spaced = not any(map(unspaced, words))
    if spaced:
        words = word_tokens(query.lower())
    if len(words) < (3 if spaced else 2) or any(map(_is_number, words)):
        return None
    kept = [w for w in words if w.lower() not in STOPWORDS]
    if spaced:
        return _forms(kept or words) or None
    forms = _forms([w for w in kept if all(map(_is_alnum, w))])
    return forms if len(forms) > 1 else None


def relaxed(query: str) -> str | None:
    """The OR of the query's words as prefixes, for a strict query that found nothing; None if it must not be relaxed."""
    words = relaxed_words(query)
    return words and " OR ".join(f'"{w}"*' if "'" in w else w + "*" for w in words)


# -- expressions


@dataclass(frozen=True)
class Phrase:
    tokens: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Op:
    name: str  # and, or, not
    parts: tuple


_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"\s*(\*)?|([()])|([^\s()"]+))')


def _plain_tokens(text: str) -> tuple[str, ...]:
    folded = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    out, word = [], ""
    for c in folded + " ":
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            word += c
        elif word:
            out.append(word)
            word = ""
    return tuple(out)


def parse(expression: str):
    """An expression tree of phrases: OR binds least, then AND (also understood between neighbours), then NOT."""
    items, at = [], 0
    expression = expression.strip()
    while at < len(expression):
        m = _TOKEN.match(expression, at)
        if not m:
            raise ValueError(f"malformed query at {expression[at:]!r}")
        at = m.end()
        if m[1] is not None:
            items.append(Phrase(_plain_tokens(m[1].replace('""', '"')), bool(m[2])))
        elif m[3]:
            items.append(m[3])
        elif m[4] in ("AND", "OR", "NOT"):
            items.append(m[4])
        else:
            items.append(Phrase(_plain_tokens(m[4].rstrip("*")), m[4].endswith("*")))
    place = 0

    def peek():
        return items[place] if place < len(items) else None

    def take():
        nonlocal place
        place += 1
        return items[place - 1]

    def primary():
        if peek() == "(":
            take()
            inner = either()
            if peek() != ")":
                raise ValueError("unbalanced parentheses in query")
            take()
            return inner
        if not isinstance(peek(), Phrase):
            raise ValueError(f"malformed query near {peek()!r}")
        return take()

    def without():
        left = primary()
        while peek() == "NOT":
            take()
            left = Op("not", (left, primary()))
        return left

    def both():
        parts = [without()]
        while peek() == "AND" or isinstance(peek(), Phrase) or peek() == "(":
            if peek() == "AND":
                take()
            parts.append(without())
        return parts[0] if len(parts) == 1 else Op("and", tuple(parts))

    def either():
        parts = [both()]
        while peek() == "OR":
            take()
            parts.append(both())
        return parts[0] if len(parts) == 1 else Op("or", tuple(parts))

    tree = either()
    if peek() is not None:
        raise ValueError("unbalanced parentheses in query")
    return tree


def phrases(tree) -> list[Phrase]:
    return [tree] if isinstance(tree, Phrase) else [p for part in tree.parts for p in phrases(part)]


def occurrences(tokens: Column, phrase: Phrase) -> Column:
    """How often the phrase stands in a token array; the last token of a prefix phrase may go on."""
    *head, last = phrase.tokens
    ends = (lambda t: t.startswith(last)) if phrase.prefix else (lambda t: t == last)
    if not head:
        return F.size(F.filter(tokens, ends))
    # shifted copies side by side: the array is looked through once, whatever the length of the phrase
    hits = F.transform(tokens, lambda t: t == head[0])
    for k, word in enumerate([*head[1:], None], 1):
        shifted = F.slice(tokens, k + 1, F.greatest(F.size(tokens) - k, F.lit(0)))
        hits = F.zip_with(hits, shifted, _both(word, ends))
    return F.size(F.filter(hits, lambda h: h))


def _both(word: str | None, ends):
    return (lambda h, t: h & ends(t)) if word is None else (lambda h, t: h & (t == word))


def holds(tree, count: dict[Phrase, Column]) -> Column:
    if isinstance(tree, Phrase):
        return count[tree] > 0
    parts = [holds(p, count) for p in tree.parts]
    if tree.name == "not":
        return parts[0] & ~parts[1]
    return reduce((lambda a, b: a & b) if tree.name == "and" else (lambda a, b: a | b), parts)


# -- matching and scores


def tokenized(rows: DataFrame) -> DataFrame:
    """rows with t_<column>, the token arrays of the indexed columns: what an index keeps. A null column has no tokens."""
    return rows.select("*", *[T.tokens(F.col(c)).alias(f"t_{c}") for c in INDEXED])


def _scored(counted: DataFrame, stats: DataFrame, tree, name: dict[Phrase, str], legs: tuple[str, ...]) -> DataFrame:
    """Rows of counted (f<k>_<column> and d) that match, with leg and score. stats: n_rows, avg_d and n_f<k>_<column>, one row."""
    leg = F.lit(None).cast("string")
    for c in reversed(legs):
        leg = F.when(holds(tree, {p: F.col(f"{name[p]}_{c}") for p in name}), F.lit(c)).otherwise(leg)
    hit = counted.withColumn("leg", leg).where("leg is not null").crossJoin(F.broadcast(stats))

    def term(p: Phrase, c: str) -> Column:
        f, n = F.col(f"{name[p]}_{c}"), F.col(f"n_{name[p]}_{c}")
        idf = F.log((F.col("n_rows") - n + 0.5) / (n + 0.5))
        idf = F.when(idf > 0, idf).otherwise(F.lit(1e-6))
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("d") / F.col("avg_d")))

    score = F.lit(None).cast("double")
    for c in reversed(legs):
        score = F.when(F.col("leg") == c, -sum((term(p, c) for p in name), F.lit(0.0))).otherwise(score)
    names = [f"{k}_{c}" for k in name.values() for c in legs]
    return hit.withColumn("score", score).drop("d", "n_rows", "avg_d", *names, *[f"n_{x}" for x in names])


def _found(counted: DataFrame, names: list[str]) -> list[Column]:
    return [F.coalesce(F.sum((F.col(k) > 0).cast("long")), F.lit(0)).alias(f"n_{k}") for k in names]


def match(index: DataFrame, expression: str, legs: tuple[str, ...] = LEGS) -> DataFrame:
    """The rows of tokenized rows that match, with leg and score, by one scan. Token columns are dropped."""
    tree = parse(expression)
    name = {p: f"f{k}" for k, p in enumerate(dict.fromkeys(p for p in phrases(tree) if p.tokens))}
    if not name:
        return index.drop(*[f"t_{c}" for c in INDEXED]).where(F.lit(False)).withColumns({"leg": F.lit(""), "score": F.lit(0.0)})
    size = sum((F.size(f"t_{c}") for c in INDEXED), F.lit(0))
    counts = {f"{k}_{c}": occurrences(F.col(f"t_{c}"), p) for p, k in name.items() for c in legs}
    counted = index.withColumns({"d": size} | counts).drop(*[f"t_{c}" for c in INDEXED])
    stats = counted.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("d").alias("avg_d"), *_found(counted, list(counts)))
    return _scored(counted, stats, tree, name, legs)


def _less(k: int):
    return lambda x: x - k


KEY = ["type", "id"]
OWNED = [*KEY, "owner"]


@dataclass(frozen=True)
class Index:
    """postings (term, column, type, id, positions), sizes (type, id, d) and stats (n_rows, avg_d, one row)."""

    postings: DataFrame
    sizes: DataFrame
    stats: DataFrame

    def _of(self, condition: Column, legs: tuple[str, ...]) -> DataFrame:
        return self.postings.where(condition & F.col("column").isin(*legs))

    def counts(self, phrase: Phrase, legs: tuple[str, ...]) -> DataFrame:
        """(column, type, id, f) of the rows that have the phrase."""
        by, out = ["column", *KEY], None
        for k, word in enumerate(phrase.tokens):
            if phrase.prefix and k == len(phrase.tokens) - 1:
                found = self._of(F.col("term").startswith(word), legs).groupBy(*by).agg(F.flatten(F.collect_list("positions")).alias("positions"))
            else:
                found = self._of(F.col("term") == word, legs).select(*by, "positions")
            if len(phrase.tokens) == 1:
                return found.select(*by, F.size("positions").alias("f"))
            found = found.select(*by, F.transform("positions", _less(k)).alias(f"p{k}"))
            out = found if out is None else out.join(found, by).select(*by, F.array_intersect("p0", f"p{k}").alias("p0")).where("size(p0) > 0")
        return out.select(*by, F.size("p0").alias("f"))

    def match(self, expression: str, legs: tuple[str, ...] = LEGS) -> DataFrame:
        """type, id, leg and score of the rows that match."""
        tree = parse(expression)
        name = {p: f"f{k}" for k, p in enumerate(dict.fromkeys(p for p in phrases(tree) if p.tokens))}
        if not name:
            return self.sizes.select(*KEY, F.lit("").alias("leg"), F.lit(0.0).alias("score")).where(F.lit(False))
        each = reduce(DataFrame.unionByName, [self.counts(p, legs).withColumn("phrase", F.lit(k)) for p, k in name.items()])
        one = lambda k, c: F.coalesce(F.max(F.when((F.col("phrase") == k) & (F.col("column") == c), F.col("f"))), F.lit(0)).alias(f"{k}_{c}")
        names = [(k, c) for k in name.values() for c in legs]
        counted = each.groupBy(*KEY).agg(*[one(k, c) for k, c in names])
        stats = self.stats.crossJoin(counted.agg(*_found(counted, [f"{k}_{c}" for k, c in names])))
        return _scored(counted.join(self.sizes.select(*KEY, "d"), KEY), stats, tree, name, legs)

    def match_scopes(self, scopes: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
        """type, id and score of the rows in which every scope (expression, columns) holds.

        Here a scope's words may stand in different columns of it, and every phrase of every scope adds to the score, with
        its occurrences counted over the scope's columns together.
        """
        trees = [(parse(e), columns) for e, columns in scopes]
        asked = list(dict.fromkeys((p, columns) for tree, columns in trees for p in phrases(tree) if p.tokens))
        if len({columns for _, columns in asked}) < len({columns for _, columns in trees}):
            return self.sizes.select(*KEY, F.lit(0.0).alias("score")).where(F.lit(False))  # a scope without a token holds nowhere
        each = reduce(DataFrame.unionByName, [self.counts(p, columns).withColumn("phrase", F.lit(k)) for k, (p, columns) in enumerate(asked)])
        total = [F.coalesce(F.sum(F.when(F.col("phrase") == k, F.col("f"))), F.lit(0)).alias(f"f{k}") for k in range(len(asked))]
        counted = each.groupBy(*KEY).agg(*total)
        stats = self.stats.crossJoin(counted.agg(*_found(counted, [f"f{k}" for k in range(len(asked))])))
        name = {scoped: F.col(f"f{k}") for k, scoped in enumerate(asked)}
        all_hold = reduce(lambda a, b: a & b, [holds(tree, {p: c for (p, of), c in name.items() if of == columns}) for tree, columns in trees])
        scored = counted.where(all_hold).join(self.sizes.select(*KEY, "d"), KEY).crossJoin(F.broadcast(stats))

        def term(k: int) -> Column:
            f, n = F.col(f"f{k}"), F.col(f"n_f{k}")
            idf = F.log((F.col("n_rows") - n + 0.5) / (n + 0.5))
            return F.when(idf > 0, idf).otherwise(F.lit(1e-6)) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("d") / F.col("avg_d")))

        return scored.select(*KEY, (-sum((term(k) for k in range(len(asked))), F.lit(0.0))).alias("score"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (type, id, owner, token arrays) as one row for each distinct term of a row's column, with its positions: runs of RUN tokens, each sorted by term."""
    for part in slices(batches, list_sizes(*range(len(OWNED), len(OWNED) + len(INDEXED))), RUN):
        for k, name in enumerate(INDEXED):
            lists = part.column(len(OWNED) + k)
            terms, n = pc.list_flatten(lists).dictionary_encode(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not n.sum():
                continue
            by_term = pc.sort_indices(terms.dictionary).to_numpy()
            place = np.empty(len(by_term), np.int64)
            place[by_term] = np.arange(len(by_term))
            keys = place[terms.indices.to_numpy()] * len(n) + np.repeat(np.arange(len(n)), n)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            position = (order - np.repeat(np.cumsum(n) - n, n)[order]).astype(np.int32)
            positions = pa.ListArray.from_arrays(pa.array(np.append(edges, len(keys)).astype(np.int32)), pa.array(position))
            term, row = np.divmod(keys[edges], len(n))
            of = [part.column(c).take(pa.array(row)) for c in range(len(OWNED))]
            yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(by_term[term])).cast(pa.string()), pa.repeat(name, len(edges)), *of, positions], ["term", "column", *OWNED, "positions"])
        del part, lists, terms


def _write_pages(postings: DataFrame, path: str) -> None:
    """In pages of few rows, so that a query reads few rows of other terms."""
    postings.write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)


def write_postings(rows: DataFrame, path: str) -> None:
    """Postings in ranges of terms, so that a term is in few files; one that many rows have goes on in the next."""
    _write_pages(rows.repartitionByRange("term", "id").sortWithinPartitions("term", "column"), path)


def write_index(rows: DataFrame, folder: str) -> Index:
    """The index of search rows, written to a folder and opened.

    Texts are split into tokens once. The positions of a term in a row's column are gathered where the row is and written
    there, in runs sorted by term: nothing is shuffled or sorted by Spark, and a query skips the pages of other terms in each
    run; merged segments have ranges of terms. Sizes are summed from the postings. Rows know their owner, the entity that
    they belong to."""
    spark = rows.sparkSession
    owned = rows.select(*KEY, F.col("entity_id" if "entity_id" in rows.columns else "id").cast("long").alias("owner"), *INDEXED)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in owned.select(*OWNED).schema)
    tokens = tokenized(owned).select(*OWNED, *[f"t_{c}" for c in INDEXED])
    _write_pages(tokens.mapInArrow(_gathered, f"term string, column string, {kinds}, positions array<int>"), f"{folder}/postings")
    found = spark.read.parquet(f"{folder}/postings").select(*OWNED, F.size("positions").alias("d"))
    found = owned.select(*OWNED, F.lit(0).alias("d")).unionByName(found)  # rows without a token too
    found.groupBy(*OWNED).agg(F.sum("d").cast("int").alias("d")).write.parquet(f"{folder}/sizes")
    spark.read.parquet(f"{folder}/sizes").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("d").alias("avg_d")).write.parquet(f"{folder}/stats")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> Index:
    return Index(*[spark.read.parquet(f"{folder}/{t}") for t in ("postings", "sizes", "stats")])


def search(index: Index, query: str, rows: DataFrame | None = None) -> tuple[DataFrame, str]:
    """Matches of a user query (among `rows` only, if given), relaxed if the strict query finds nothing; and the expression used."""
    expression = prepare(query)
    if expression is None:
        return index.match('""'), ""
    among = lambda found: found if rows is None else found.join(rows.select(*KEY), KEY, "left_semi")
    found = among(index.match(expression))
    loose = relaxed(query)
    if loose and not found.limit(1).count():
        return among(index.match(loose)), loose
    return found, expression


def batch_terms(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, type, id, score) of many one-term queries (query_id, term) at once, by their leg columns.

    Terms meet postings by an equi-join, so a thousand queries cost one pass over the postings, not a thousand.
    """
    rank = F.when(F.col("column") == LEGS[0], 0).when(F.col("column") == LEGS[1], 1).otherwise(2)
    asked = index.postings.where(F.col("column").isin(*LEGS)).select("term", "column", *KEY, F.size("positions").alias("f")).join(queries.select("term").distinct(), "term")
    df = asked.groupBy("term", "column").agg(F.count(F.lit(1)).alias("n"))
    scored = asked.join(df, ["term", "column"]).join(index.sizes.select(*KEY, "d"), KEY).crossJoin(F.broadcast(index.stats))
    idf = F.log((F.col("n_rows") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(F.lit(1e-6))
    score = -idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("d") / F.col("avg_d")))
    first = scored.groupBy("term", *KEY).agg(F.min_by(score, rank).alias("score"))
    return queries.join(first, "term").select("query_id", *KEY, "score")
