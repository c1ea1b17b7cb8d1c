"""The registered queries: each applies one operator of the engine to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, edits, markdown
from ..functions import text as T
from ..functions.batches import slices, text_sizes
from ..operators import directory, filters, fulltext, graph, indexing, paging, schema, segments, vectors
from ..sources import scratch
from ..streaming import watch
from . import corpus
from .corpus import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PAGE = 25


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _scored(found: DataFrame, k: int = PAGE) -> DataFrame:
    return found.withColumn("score", F.round("score", 6)).orderBy("score", "type", "id").limit(k).select("type", "id", "leg", "score")


# -- full text


@query
def fts_prefix_bm25(spark, sf_dir):
    found, _ = fulltext.search(corpus.text_index(spark, sf_dir), "therea")
    return _scored(found)


@query
def fts_and_terms(spark, sf_dir):
    found, _ = fulltext.search(corpus.text_index(spark, sf_dir), "whst erea")
    return _scored(found)


@query
def fts_or_not(spark, sf_dir):
    found, _ = fulltext.search(corpus.text_index(spark, sf_dir), "therea OR ereres NOT license")
    return _scored(found)


@query
def fts_phrase(spark, sf_dir):
    return _scored(corpus.text_index(spark, sf_dir).match('"under the"'))


@query
def fts_title(spark, sf_dir):
    return _scored(corpus.text_index(spark, sf_dir).match(fulltext.prepare_title("Doc 7"), legs=("title",)))


@query
def fts_scopes(spark, sf_dir):
    """A text beside a title and a permalink filter: one match over all, in which every leg adds to the score."""
    found = corpus.text_index(spark, sf_dir).match_scopes([(fulltext.prepare("therea"), fulltext.LEGS)] + filters.scopes(filters.Filters(title="Doc", permalink_match="en")))
    return found.withColumn("score", F.round("score", 6))


@query
def fts_after_update(spark, sf_dir):
    """A search in an index of two segments: all documents, then those that were edited, with the removed ones marked as gone."""
    rows, store = corpus.index(spark, sf_dir), segments.Store(spark, scratch.new_path(spark, "segments"))
    first, second = store.new_name(), store.new_name()
    store.write(first, {"search_index": rows, "gone": rows.select("id").limit(0)})
    manifest = store.append(None, first, {"skipped": ""})
    edited = rows.where("id % 7 = 3 and id % 11 <> 4").withColumns({c: F.concat(c, F.lit(" therea renewed")) for c in ("content_stems", "content_snippet")})
    store.write(second, {"search_index": edited, "gone": rows.where("id % 7 = 3 or id % 11 = 4").select("id")})
    store.append(manifest, second, {})
    return _scored(store.index().match(fulltext.prepare("therea")))


@query
def fts_relaxed_or(spark, sf_dir):
    found, _ = fulltext.search(corpus.text_index(spark, sf_dir), "what is qqqzz therea zzqqq")
    return _scored(found)


@query
def fts_query_batch(spark, sf_dir):
    """Every distinct token of every benchmark item; a token of many items is looked up once."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    found = fulltext.batch_terms(corpus.text_index(spark, sf_dir), asked.select(F.col("term").alias("query_id"), "term").distinct())
    sums = found.groupBy(F.col("query_id").alias("term")).agg(F.count(F.lit(1)).alias("n_found"), F.round(F.sum("score"), 4).alias("sum_score"))
    return asked.join(sums, "term").select("item_id", "term", "n_found", "sum_score")


@query
def posting_counts(spark, sf_dir):
    return corpus.text_index(spark, sf_dir).postings.groupBy("term").agg(F.sum(F.size("positions")).alias("n"), F.count_distinct("id").alias("n_rows"))


# -- filters and pages


@query
def filter_note_type(spark, sf_dir):
    return filters.apply(corpus.index(spark, sf_dir), filters.Filters(note_types=("SRC3", "src7"))).select("id", "permalink")


@query
def filter_metadata_json(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.where(F.get_json_object("props", "$.k") == "7").select("event_id", "event_type")


@query
def filter_permalink_glob(spark, sf_dir):
    return filters.apply(corpus.index(spark, sf_dir), filters.Filters(permalink_match="src1*/en/doc-?[0-4]*")).select("id", "permalink")


@query
def filter_permalink_token(spark, sf_dir):
    return filters.apply(corpus.index(spark, sf_dir), filters.Filters(permalink_match="77")).select("id", "permalink")


@query
def filter_after_date(spark, sf_dir):
    return filters.apply(corpus.index(spark, sf_dir), filters.Filters(after="2023-12-01 00:00:00")).select("id", "updated_at")


@query
def filter_owner_semi(spark, sf_dir):
    e = corpus.entities(spark, sf_dir)
    return filters.apply(corpus.index(spark, sf_dir), filters.Filters(status="fr", metadata={"source": "src2", "not-a-word": "x"}), e).select("id", "permalink")


@query
def filter_first_tag(spark, sf_dir):
    e = corpus.entities(spark, sf_dir)
    return filters.apply(corpus.index(spark, sf_dir), filters.Filters(tags=("de", "fr")), e).select("id", "permalink")


@query
def page_with_total(spark, sf_dir):
    rows = corpus.index(spark, sf_dir).where(F.col("permalink").startswith("src4/"))
    return paging.with_total(rows, [F.desc("updated_at"), F.col("id")], 2, PAGE).select("id", "total")


@query
def all_projects_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("score"))
    return paging.merge_projects(rows, "source", "score", [F.col("score"), F.col("doc_id")], 2, PAGE).select("source", "doc_id", "score", F.col("pos").cast("long").alias("pos"))


# -- scalar functions


@query
def permalink_generate(spark, sf_dir):
    name = F.concat(F.lit("People & Places\\"), F.col("c_mktsegment"), F.lit("/"), F.col("c_name"), F.lit("__v1.MD"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.permalink(name).alias("permalink"))


@query
def note_type_normalize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.note_type(F.concat(F.lit(" My"), F.initcap("p_type"), F.lit("-"), F.col("p_brand"), F.lit(".x "))).alias("note_type"))


@query
def text_variants(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.join_variants(T.variants(F.concat_ws("/", "c_mktsegment", F.concat(F.col("c_name"), F.lit(" Note"))))).alias("stems"))


@query
def external_id(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.external_id(F.concat(F.lit("project:"), F.col("c_name"))).alias("external_id"))


@query
def observation_permalinks(spark, sf_dir):
    """Of the whole texts, so that the digest tells long ones apart."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", T.observation_permalink(F.concat(F.lit("conv-"), F.col("conv_id")), F.col("role"), F.col("text")).alias("permalink"))


@query
def relation_titles(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").where("n_nationkey < 20")
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("c_custkey", indexing.relation_title(F.col("c_name"), F.col("n_name")).alias("title"), T.relation_permalink(F.lower("c_name"), F.lit("lives in"), F.coalesce(F.lower("n_name"), F.lit("nowhere"))).alias("permalink"))


@query
def entity_search_rows(spark, sf_dir):
    rows = indexing.entity_rows(corpus.entities(spark, sf_dir).withColumn("created_at", F.col("updated_at")))
    return rows.select("id", "type", "permalink", F.length("content_stems").cast("long").alias("n_stems"), F.sha2("content_stems", 256).alias("stems_hash"), "metadata")


# -- chunks and vectors


@query
def chunk_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(chunking.windows(F.col("text"))).alias("chunk", "text")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("source_hash"))


@query
def entity_fingerprint(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select("doc_id", F.posexplode(chunking.windows(F.col("text"))).alias("n", "t")).select("doc_id", F.concat_ws(":", F.lit("entity"), "doc_id", "n").alias("chunk_key"), F.sha2("t", 256).alias("source_hash"))
    return chunking.fingerprint(chunks, "doc_id")


@query
def chunk_notes(spark, sf_dir):
    """The structured chunker over whole texts (greedy merging is sequential, so no SQL)."""
    rows = corpus.index(spark, sf_dir).withColumn("relation_type", F.lit(None).cast("string"))
    return chunking.chunk_records(rows).groupBy("id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("chunk_text")).alias("n_chars"))


@query
def vector_reuse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("entity:"), F.col("doc_id"), F.lit(":0")).alias("chunk_key"), F.sha2("text", 256).alias("source_hash"))
    stored = docs.where("doc_id % 3 <> 0").select("chunk_key", F.when(F.col("doc_id") % 5 == 0, F.lit("stale")).otherwise(F.col("source_hash")).alias("source_hash"), F.array(F.lit(1.0)).alias("embedding"))
    return indexing.reusable_vectors(docs, stored).select("doc_id", F.col("embedding").isNotNull().alias("reused"))


def _query_vector(spark, sf_dir):
    return F.broadcast(table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q")))


@query
def knn_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").crossJoin(_query_vector(spark, sf_dir))
    return vectors.nearest(rows, F.col("q"), PAGE, ["vec_id"]).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query
def knn_query_batch(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.nearest_for_queries(e, asked, 5).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query
def knn_best_per_row(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").crossJoin(_query_vector(spark, sf_dir)).select("vec_id", "label", vectors.dot(F.col("embedding"), F.col("q")).alias("similarity"))
    return vectors.best_per_row(rows, ["label"], "vec_id", floor=0.2).select("label", F.round("score", 6).alias("score"), F.array_join("chunks", ",").alias("chunks"))


def _vector_leg(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").crossJoin(_query_vector(spark, sf_dir))
    return rows.select(F.col("vec_id").alias("id"), vectors.dot(F.col("embedding"), F.col("q")).alias("score")).where("score >= 0.1")


@query
def hybrid_fusion(spark, sf_dir):
    found, _ = fulltext.search(corpus.text_index(spark, sf_dir), "therea")
    fused = vectors.fuse(vectors.normalize_scores(found.select("id", "score")), _vector_leg(spark, sf_dir), ["id"])
    return fused.select("id", *[F.round(c, 6).alias(c) for c in ("text_score", "vector_score", "score")])


@query
def rerank_tail(spark, sf_dir):
    """Over the whole leg, with a score for every row of it, of which rerank picks those it needs."""
    ranked = indexing.ranked(_vector_leg(spark, sf_dir).withColumn("minus", -F.col("score")), ["minus", "id"], "pos").select("id", "pos")
    scores = ranked.select("id", ((F.col("pos") * 7) % 20 / 20.0).alias("rerank_score"))
    return vectors.rerank(ranked, scores, ["id"]).select("id", F.col("pos").cast("long").alias("pos"), F.round("score", 6).alias("score"))


# -- links, graph, context


@query
def resolve_links(spark, sf_dir):
    e = corpus.entities(spark, sf_dir)
    kind = F.col("id") % 4
    name = F.when(kind == 0, F.col("permalink")).when(kind == 1, F.col("file_path")).when(kind == 2, F.concat(F.col("permalink"), F.lit("|label"))).otherwise(F.concat(F.col("permalink"), F.lit("-gone")))
    known = F.when(F.col("id") % 9 == 0, F.lit(-7).cast("long"))  # resolved before: stays
    targets = e.select(F.col("id").alias("link_id"), name.alias("to_name"), known.alias("to_id"), ((F.col("id") + (F.col("id") % 5 == 0).cast("int")) % 2).alias("project_id"))
    found = indexing.resolve_links(targets, e.withColumn("project_id", F.col("id") % 2))
    return found.select("link_id", "to_name", F.coalesce("to_id", F.lit(-1)).alias("to_id"))


def _seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


@query
def graph_depth1(spark, sf_dir):
    e, r = corpus.graph(spark, sf_dir)
    found = graph.traverse(e, r, _seeds(spark, corpus.CUSTOMER + 7, corpus.NATION + 3), 1)
    return graph.related(found, 40).select("root_id", "type", "id", "title", F.col("depth").cast("long").alias("depth"))


@query
def graph_depth2(spark, sf_dir):
    e, r = corpus.graph(spark, sf_dir)
    found = graph.traverse(e, r, _seeds(spark, corpus.CUSTOMER + 11), 2)
    return found.select("root_id", "type", "id", "title", F.col("depth").cast("long").alias("depth"))


@query
def graph_since(spark, sf_dir):
    e, r = corpus.graph(spark, sf_dir)
    found = graph.traverse(e, r, _seeds(spark, corpus.CUSTOMER + 11, corpus.CUSTOMER + 12), 1, since="1997-01-01T00:00:00")
    return found.select("root_id", "type", "id", "title", F.col("depth").cast("long").alias("depth"))


@query
def context_counts(spark, sf_dir):
    e, r = corpus.graph(spark, sf_dir)
    seen = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + corpus.ORDER).alias("entity_id"))
    return graph.context_counts(graph.traverse(e, r, _seeds(spark, *[corpus.CUSTOMER + k for k in range(1, 60)]), 1), seen)


@query
def recent_activity(spark, sf_dir):
    rows = corpus.index(spark, sf_dir)
    return graph.recent(rows, F.lit("2023-12-01 00:00:00").cast("timestamp_ntz"), 2, PAGE).select("type", "id", "updated_at")


@query
def recent_context_roots(spark, sf_dir):
    """The thousand newest entities with what is related to them, cut to 100 rows over all."""
    e, r = corpus.graph(spark, sf_dir)
    rows = e.select(F.lit("entity").alias("type"), "id", "title", F.col("created_at").cast("timestamp_ntz").alias("updated_at"))
    notes = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + corpus.ORDER).alias("entity_id"))
    found = graph.recent_context(rows, e, r, notes, "1992-01-01 00:00:00", 1, 1000, 1, 100)
    named = F.transform("related", lambda x: F.concat_ws(":", x["depth"].cast("string"), x["type"], x["id"].cast("string"), x["title"]))
    return found.select(F.col("pos").cast("long").alias("pos"), "id", "title", "n_observations", "n_relations", F.array_join(named, ",").alias("related"))


# -- directories, changes, streams


@query
def directory_listing(spark, sf_dir):
    found, _ = directory.listing(corpus.entities(spark, sf_dir).select("file_path", "title", "updated_at"), depth=2, glob="*1*")
    return found.select("path", "name", "kind", F.col("depth").cast("long").alias("depth"))


@query
def directory_page(spark, sf_dir):
    found, order = directory.listing(corpus.entities(spark, sf_dir).select("file_path", "title", "updated_at"), "src1", depth=3, order="title_desc")
    return found.orderBy(*order).limit(PAGE).select("path", "kind", F.col("depth").cast("long").alias("depth"))


def _snapshot(spark, sf_dir, kept: str, edited: str):
    key = F.concat(F.lit("o/"), F.col("o_orderkey"), F.lit(".md"))
    body = F.concat_ws("|", "o_orderstatus", "o_orderpriority", F.when(F.expr(edited), F.lit("edited")))
    return table(spark, sf_dir, "orders").where(kept).select(key.alias("file_path"), F.sha2(body, 256).alias("checksum"))


@query
def reconcile_diff(spark, sf_dir):
    return indexing.reconcile(_snapshot(spark, sf_dir, "o_orderkey % 7 <> 0", "o_orderkey % 5 = 0"), _snapshot(spark, sf_dir, "o_orderkey % 11 <> 0", "false"))


@query
def move_pairing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.sha2("text", 256).alias("checksum"))
    gone = docs.where("doc_id % 2 = 0").select("checksum", F.concat(F.lit("old/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("file_path"))
    new = docs.where("doc_id % 3 = 0").select("checksum", F.concat(F.lit("new/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("file_path"))
    return indexing.pair_moves(gone, new)


@query
def cascade_delete(spark, sf_dir):
    e, r = corpus.graph(spark, sf_dir)
    tables = {"entity": e, "relation": r, "observation": e.select(F.col("id").alias("entity_id")), "search_index": e.select(F.col("id").alias("entity_id"))}
    left = indexing.remove(tables, e.where(F.col("title").endswith("7")))
    return left["relation"].groupBy("relation_type").agg(F.count(F.lit(1)).alias("n_relations"))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u/"), F.col("user_id"), F.lit(".md")).alias("path"), F.col("event_type").alias("kind"), "ts", "event_id")


@query
def debounce_islands(spark, sf_dir):
    found = watch.islands(_events(spark, sf_dir), 6 * 3600, "event_id")
    return found.select("path", F.col("burst").cast("long").alias("burst"), "kind", "first_ts", "last_ts", "n_events")


@query
def debounce_sessions(spark, sf_dir):
    return watch.debounce(_events(spark, sf_dir), "6 hours").select("path", "first_ts", "last_ts", "n_events")


@query
def ranked_ids(spark, sf_dir):
    return indexing.ranked(corpus.entities(spark, sf_dir).select(F.col("id").alias("doc_id"), "file_path"), ["file_path"]).select("doc_id", "id")


# -- schemas


@query
def schema_infer(spark, sf_dir):
    values, notes = corpus.field_values(spark, sf_dir)
    found = schema.infer(values, notes)
    return found.select("field", "n_notes", "total", F.round("percentage", 6).alias("percentage"), "is_array", F.sha2(F.array_join("samples", "|"), 256).alias("samples_hash"), "suggestion")


FIELDS = {"user": "string", "summary?": "string", "tool(array)": "string", "assistant": "string"}


@query
def schema_diff(spark, sf_dir):
    values, notes = corpus.field_values(spark, sf_dir)
    return schema.drift(schema.field_table(spark, schema.parse_fields(FIELDS)), schema.frequencies(values, notes, 3))


@query
def schema_validate_enum(spark, sf_dir):
    values = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("note"), F.col("o_orderpriority").alias("value"), F.lit("priority").alias("field"))
    notes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("note"))
    fields = schema.field_table(spark, schema.parse_fields({"priority(enum)": ["1-URGENT", "2-HIGH", "3-MEDIUM"], "owner?": "Person"}))
    return schema.validate(values, notes, fields).select("note", "field", "status", F.array_join("wrong", ",").alias("wrong"))


@query
def schema_totals(spark, sf_dir):
    values = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("note"), F.col("o_orderstatus").alias("value"), F.lit("status").alias("field"))
    customers = table(spark, sf_dir, "customer")
    fields = schema.field_table(spark, schema.parse_fields({"status(enum)": ["F", "O"]}))
    reports = schema.report(schema.validate(values, customers.select(F.col("c_custkey").alias("note")), fields), "strict")
    return schema.totals(reports.join(customers.select(F.col("c_custkey").alias("note"), F.col("c_mktsegment").alias("type")), "note"))


@query
def schema_findings(spark, sf_dir):
    values = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("note"), F.col("o_orderkey").alias("place"), F.col("o_orderstatus").alias("value"), F.lit("status").alias("field"))
    notes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("note"))
    return schema.findings(values, notes, schema.field_table(spark, schema.parse_fields({"status(enum)": ["F", "O"], "boss": "Person"})))


@query
def schema_unmatched(spark, sf_dir):
    values, _ = corpus.field_values(spark, sf_dir)
    return schema.unmatched(values, schema.field_table(spark, schema.parse_fields({"user": "string"})))


# -- notes (no SQL: the grammar is Python)


@query
def parse_notes(spark, sf_dir):
    """Documents wrapped as notes with frontmatter, a list of observations and relations, and parsed back."""
    docs = table(spark, sf_dir, "documents")
    head = F.concat(F.lit("---\ntitle: Doc "), F.col("doc_id"), F.lit("\ntype: "), F.col("source"), F.lit("\ntags:\n- "), F.col("lang"), F.lit("\n---\n\n# Text\n\n"))
    body = F.concat(F.lit("- [size] "), F.col("n_chars"), F.lit(" characters #size (counted)\n- part_of [["), F.col("source"), F.lit("|Source]]\n\n```\n"), F.col("text"), F.lit("\n```\n"))
    notes = markdown.parse_notes(docs.select(F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".md")).alias("file_path"), "doc_id", F.concat(head, body).alias("text")))
    o, r = F.col("observations")[0], F.col("relations")[0]
    return notes.select("doc_id", "title", "note_type", F.array_join("tags", ",").alias("tags"), o["category"].alias("category"), o["content"].alias("content"), o["context"].alias("context"), r["relation_type"].alias("relation_type"), r["to_name"].alias("to_name"))


def _edited(batches):
    import pyarrow as pa

    for part in slices(batches, text_sizes(1)):
        out = [edits.edit(f"## Intro\n{t or ''}\n## End\n", "replace_section", "Replaced.", section="End") for t in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out)], ["doc_id", "text"])
        del part, out


@query
def edit_notes(spark, sf_dir):
    """An edit applied to every document as a note, in slices of Arrow batches."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(_edited, "doc_id long, text string").select("doc_id", F.sha2("text", 256).alias("hash"))


@query
def resolve_identifiers(spark, sf_dir):
    """Every document's title, permalink, path and an end of its permalink, resolved at once."""
    e = corpus.entities(spark, sf_dir)
    said = F.array("title", F.col("permalink"), F.concat(F.lit("memory://"), F.col("file_path")), F.concat_ws("/", F.element_at("tags", 1), F.element_at(F.split("permalink", "/"), -1)), F.concat(F.lit("no such "), F.col("id")))
    asked = e.select(F.col("id").alias("doc_id"), F.posexplode(said).alias("n", "identifier"))
    return graph.resolve_identifiers(asked, e).select("doc_id", F.col("n").cast("long").alias("n"), "identifier", "id", "kind")


@query
def search_project_totals(spark, sf_dir):
    """Languages as projects: how many rows a search finds in all of them, and whether others follow the first page."""
    found = corpus.text_index(spark, sf_dir).match(fulltext.prepare("therea"))
    where = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    return paging.project_totals(found.join(where, "id"), "lang", 1, PAGE)


@query
def schema_validate_all(spark, sf_dir):
    """Conversations as notes of three types, each held against the schema that is its own, that it names, or that of its type."""
    turns = table(spark, sf_dir, "conversations")
    n = F.col("conv_id")
    said = F.when(n % 5 == 0, F.to_json(F.struct(F.struct(F.lit("string").alias("system")).alias("schema")))).when(n % 5 == 1, F.lit('{"schema": "chat0"}')).otherwise(F.to_json(F.struct(F.when(n % 2 == 0, "a").otherwise("b").alias("topic"))))
    notes = turns.select(n.alias("id"), said.alias("entity_metadata")).distinct().select("id", F.lit("").alias("file_path"), F.concat(F.lit("chat"), F.col("id") % 3).alias("note_type"), "entity_metadata")
    known = [
        (-1, "s/0.md", "schema", '{"entity": "chat0", "schema": {"user": "string", "assistant": "string", "tool?": "string"}, "settings": {"frontmatter": {"topic(enum)": ["a"]}}}'),
        (-2, "s/1.md", "schema", '{"entity": "chat1", "schema": {"system": "string"}, "settings": {"validation": "strict"}}'),
    ]
    entities = notes.unionByName(spark.createDataFrame(known, "id long, file_path string, note_type string, entity_metadata string"))
    values = turns.select(n.alias("note"), F.lit("observation").alias("source"), F.col("turn").cast("int").alias("place"), F.col("role").alias("field"), F.col("text").alias("value")).unionByName(schema.frontmatter_values(entities))
    return schema.reports(schema.check(schema.resolve(entities, schema.definitions(entities)), values))
