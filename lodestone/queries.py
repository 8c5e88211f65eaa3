"""The engine's operators over the test tables, each with its DuckDB twin.

``documents`` stand for chunks (path made of source, lang and id), ``embeddings``
for their vectors, ``pages`` for paths, ``events`` for change notifications,
``region`` to ``supplier`` for a containment graph and ``orders``/``lineitem`` for
call edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_sql as sql
from .functions import paths, text, vectors
from .operators import ann, chunk, graph, hierarchy, incremental, lexical, rank
from .plans import planner
from .sources import repo
from .streaming import watch

QUERY = sql.QUERY
FILTERED = planner.SearchOptions(limit=10, glob=["src1/**", "src0/**"], filters=["lang=EN", "path=doc_", "type=function", "loose"])

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """documents as chunks."""
    ext = F.create_map(*[x for k, v in sql.EXT.items() for x in (F.lit(k), F.lit(v))])
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_idx"),
        F.col("doc_id").cast("string").alias("id"),
        F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.try_element_at(ext, F.col("lang"))).alias("path"),
        F.col("lang").alias("language"),
        F.lit(1).alias("start_line"),
        F.col("text"),
        F.sha2("text", 256).alias("hash"),
        F.col("source"),
    )


def indexed(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks with vectors; where there are fewer vectors than documents, they go round."""
    vec = table(spark, sf, "embeddings").select(F.col("vec_id").alias("__vec"), F.col("embedding").alias("vector"), "label")
    return chunks(spark, sf).withColumn("__vec", F.col("chunk_idx") % max(vec.count(), 1)).join(vec, "__vec").drop("__vec")


def vecs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_idx"), F.col("embedding").alias("vector"), "label")


def query_vector(spark: SparkSession, sf: str) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


def r6(c) -> F.Column:
    return F.round(c, 6)


# --- text --------------------------------------------------------------------


@query
def tok_count(spark, sf):
    return chunks(spark, sf).select("chunk_idx", F.size(text.tokenize(F.col("text"))).cast("long").alias("n_tokens"))


@query
def tok_terms(spark, sf):
    return chunks(spark, sf).select(F.explode(text.tokenize(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query
def kw_extract(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(text.keywords(F.col("text")), " ").alias("keywords"))


@query
def stem_terms(spark, sf):
    terms = chunks(spark, sf).select(F.explode(text.tokenize(F.col("text"))).alias("term")).distinct()
    return terms.select("term", text.stem(F.col("term")).alias("stem"))


@query
def est_tokens(spark, sf):
    return chunks(spark, sf).select("chunk_idx", text.estimate_tokens(F.col("text")).cast("long").alias("n_tokens"))


# --- lexical -----------------------------------------------------------------


def _plain(spark, sf):
    return lexical.score(chunks(spark, sf), lexical.plain_field(F.col("text")), lexical.query_terms(spark, QUERY, stemmed=False))


def _boosted(spark, sf):
    return lexical.score(chunks(spark, sf), lexical.boosted_fields(F.col("text"), F.col("path")), lexical.query_terms(spark, QUERY))


@query
def bm25_plain(spark, sf):
    return _plain(spark, sf).where("bm25 > 0").select("chunk_idx", r6("bm25").alias("score"))


@query
def bm25_topk(spark, sf):
    return rank.top(_plain(spark, sf).where("bm25 > 0"), 10, "bm25", ("chunk_idx",)).select("chunk_idx", r6("bm25").alias("score"))


@query
def bm25f_fields(spark, sf):
    return _boosted(spark, sf).select("chunk_idx", r6("bm25").alias("score"))


@query
def bm25f_symbols(spark, sf):
    named = chunks(spark, sf).withColumn("symbols", F.slice(text.tokenize(F.col("text")), 1, 3))
    return lexical.score(named, planner.fields_of(named), lexical.query_terms(spark, QUERY)).select("chunk_idx", r6("bm25").alias("score"))


@query
def bm25f_topk(spark, sf):
    return rank.top(_boosted(spark, sf).where("bm25 > 0"), 10, "bm25", ("chunk_idx",)).select("chunk_idx", r6("bm25").alias("score"))


@query
def bm25f_postings(spark, sf):
    c, f = chunks(spark, sf), lexical.boosted_fields(F.col("text"), F.col("path"))
    return lexical.score_postings(lexical.postings(c, "chunk_idx", f), lexical.corpus_stats(lexical.lengths(c, "chunk_idx", f)), "chunk_idx", lexical.query_terms(spark, QUERY)).select(
        "chunk_idx", r6("bm25").alias("score")
    )


@query
def bm25_norm(spark, sf):
    return rank.normalise(_plain(spark, sf)).select("chunk_idx", r6("bm25_norm").alias("score"))


@query
def corpus_stats(spark, sf):
    s = lexical.corpus_stats(lexical.lengths(chunks(spark, sf), "chunk_idx", lexical.boosted_fields(F.col("text"), F.col("path"))))
    return s.select(F.col("n").cast("long"), r6("avgdl").alias("avgdl"), F.col("total").cast("long"))


@query
def doc_freq_top(spark, sf):
    p = lexical.postings(chunks(spark, sf), "chunk_idx", lexical.boosted_fields(F.col("text"), F.col("path")))
    return lexical.document_frequency(p).orderBy(F.desc("df"), "term").limit(50)


# --- vectors -----------------------------------------------------------------


@query
def cosine_topk(spark, sf):
    return ann.exact(vecs(spark, sf), vectors.literal(query_vector(spark, sf)), 10).select("chunk_idx", r6("semantic").alias("score"))


@query
def cosine_arrow(spark, sf):
    return vecs(spark, sf).select("chunk_idx", r6(vectors.cosine_udf(query_vector(spark, sf))("vector")).alias("score"))


@query
def quantize_bits(spark, sf):
    return vecs(spark, sf).select("chunk_idx", F.array_join(F.transform(vectors.quantise(F.col("vector")), lambda w: w.cast("string")), ",").alias("bits"))


@query
def hamming_topk(spark, sf):
    return ann.hamming_shortlist(vecs(spark, sf), vectors.literal(query_vector(spark, sf)), 20).select("chunk_idx", F.col("distance").cast("long"))


@query
def two_phase_topk(spark, sf):
    return ann.two_phase(vecs(spark, sf), vectors.literal(query_vector(spark, sf)), 10).select("chunk_idx", r6("semantic").alias("score"))


@query
def ann_oversample(spark, sf):
    return ann.oversampled(vecs(spark, sf), vectors.literal(query_vector(spark, sf)), 10).select("chunk_idx", r6("semantic").alias("score"))


def _cells(spark, sf):
    """The inverted file over all vectors: (rows with their cell, centres)."""
    cells = ann.Cells.fit(vecs(spark, sf))
    return cells.assign(vecs(spark, sf)), cells


@query
def ann_cells(spark, sf):
    """Every vector with its cell; no row is left out."""
    rows, cells = _cells(spark, sf)
    return rows.select("chunk_idx", (F.col("cell").isNotNull() & (F.col("cell") < len(cells.centres))).alias("placed"))


@query
def ann_recall(spark, sf):
    """The share of the ten nearest rows that the index finds, for every vector whose id 100 divides."""
    rows, cells = _cells(spark, sf)
    asked = table(spark, sf, "embeddings").where("vec_id % 100 = 0").select("embedding")
    found = ann.recall(rows, cells, (r[0] for r in asked.toLocalIterator()))
    return spark.createDataFrame([(asked.count(), found >= 0.9)], "n_queries bigint, enough boolean")


@query
def l2_norm(spark, sf):
    scaled = F.transform("vector", lambda x: x.cast("double") * 3)
    return vecs(spark, sf).withColumn("u", vectors.l2_normalise(scaled)).select("chunk_idx", r6(vectors.norm(F.col("u"))).alias("norm"), r6(F.element_at("u", 1)).alias("first"))


@query
def dim_truncate(spark, sf):
    v = vectors.truncate(F.col("vector"), 16)
    return vecs(spark, sf).select("chunk_idx", F.size(v).cast("long").alias("dim"), r6(vectors.norm(v)).alias("norm"))


def _files(spark, sf):
    """Vectors grouped by label as files dir<label % 3>/f<label>."""
    rows = vecs(spark, sf).withColumn("path", F.concat(F.lit("dir"), (F.col("label") % 3).cast("string"), F.lit("/f"), F.col("label").cast("string")))
    return hierarchy.files(rows)


@query
def file_rollup(spark, sf):
    return _files(spark, sf).select("path", F.col("chunk_count").cast("long"), r6(F.element_at("vector", 1)).alias("v1"), r6(vectors.norm(F.col("vector"))).alias("norm"))


@query
def dir_rollup(spark, sf):
    return hierarchy.directories(_files(spark, sf)).select("path", F.col("file_count").cast("long"), F.col("chunk_count").cast("long"), r6(F.element_at("vector", 1)).alias("v1"))


@query
def search_files(spark, sf):
    return hierarchy.search(_files(spark, sf), vectors.literal(query_vector(spark, sf)), 5).select("path", F.col("chunk_count").cast("long"), r6("score").alias("score"))


@query
def search_dirs(spark, sf):
    found = hierarchy.search(hierarchy.directories(_files(spark, sf)), vectors.literal(query_vector(spark, sf)), 5)
    return found.select("path", F.col("file_count").cast("long"), F.col("chunk_count").cast("long"), r6("score").alias("score"))


# --- retrieval -----------------------------------------------------------------


def _hybrid(spark, sf, options):
    q = query_vector(spark, sf)
    found = planner.search(indexed(spark, sf), QUERY, lambda _: q, options)
    return found.select("chunk_idx", r6("score").alias("score"), r6("semantic").alias("semantic"), r6("bm25").alias("bm25"))


@query
def hybrid_linear(spark, sf):
    return _hybrid(spark, sf, planner.SearchOptions(strategy="linear"))


@query
def hybrid_filtered(spark, sf):
    return _hybrid(spark, sf, FILTERED)


@query
def hybrid_hnsw(spark, sf):
    return _hybrid(spark, sf, planner.SearchOptions(strategy="ann"))


@query
def hybrid_binary(spark, sf):
    return _hybrid(spark, sf, planner.SearchOptions(strategy="binary"))


@query
def strategy_pick(spark, sf):
    n = indexed(spark, sf).count()
    rows = [(str(k), planner.choose(k, planner.SearchOptions()), planner.choose(k, planner.SearchOptions(filters=["lang=en"]))) for k in (1, 499, 500, 999, 1000, 100000)]
    return spark.createDataFrame([*rows, ("corpus", planner.choose(n, planner.SearchOptions()), "linear")], "n string, plain string, filtered string")


def _first_pass(spark, sf):
    q = query_vector(spark, sf)
    chunks_ = indexed(spark, sf)
    best = rank.top(planner.score_pass(chunks_, QUERY, q, "linear", planner.SearchOptions()), 10)
    return rank.top(planner.with_chunks(best, chunks_), 10)


@query
def prf_terms(spark, sf):
    return rank.feedback_terms(_first_pass(spark, sf), QUERY).select("term", "n")


@query
def prf_expanded_query(spark, sf):
    return spark.createDataFrame([(rank.expand(QUERY, _first_pass(spark, sf)),)], "expanded string")


@query
def prf_two_pass(spark, sf):
    q = query_vector(spark, sf)
    first = _first_pass(spark, sf)
    second = planner.score_pass(indexed(spark, sf), rank.expand(QUERY, first), q, "linear", planner.SearchOptions())
    return rank.max_merge(first.select(*second.columns), second).select("chunk_idx", r6("score").alias("score"))


@query
def dedup_hash(spark, sf):
    rows = chunks(spark, sf).withColumn("score", F.length("text").cast("double"))
    return rank.drop_equal_hashes(rows, ties=("chunk_idx",)).select("chunk_idx")


@query
def dedup_semantic(spark, sf):
    q = vectors.literal(query_vector(spark, sf))
    best = ann.exact(vecs(spark, sf), q, 60).withColumn("hash", (F.col("chunk_idx") % 50).cast("string")).withColumnRenamed("semantic", "score")
    return rank.suppress_near_duplicates(best, 0.3, ties=("chunk_idx",)).select("chunk_idx")


def _page_paths(spark, sf):
    """pages' URLs as paths, with a suffix that varies by id."""
    suffix = F.get(F.array(*[F.lit(s) for s in sql.SUFFIXES]), (F.col("page_id") % len(sql.SUFFIXES)).cast("int"))
    return table(spark, sf, "pages").select("page_id", F.concat(F.regexp_replace("url", r"^[a-z]+://", ""), suffix).alias("path"))


@query
def file_type_class(spark, sf):
    return _page_paths(spark, sf).select("page_id", paths.classify(F.col("path")).alias("file_type"))


@query
def file_type_priority(spark, sf):
    return _page_paths(spark, sf).select("page_id", paths.priority(F.col("path")).alias("factor"))


@query
def path_parts(spark, sf):
    p = F.col("path")
    return _page_paths(spark, sf).select("page_id", paths.file_stem(p).alias("stem"), paths.parent(p).alias("parent"), paths.language(p).alias("language"))


@query
def glob_any(spark, sf):
    return _page_paths(spark, sf).where(paths.glob_filter(F.col("path"), ["**/*.py", "*1/docs/*", "[broken"])).select("page_id")


@query
def filter_lang(spark, sf):
    return chunks(spark, sf).where(paths.metadata_filter(["lang=FR"], F.col("path"), F.col("language"))).select("chunk_idx")


@query
def filter_path(spark, sf):
    return chunks(spark, sf).where(paths.metadata_filter(["path=SRC1", "file=doc_1"], F.col("path"), F.col("language"))).select("chunk_idx")


@query
def filter_unknown(spark, sf):
    return chunks(spark, sf).where(paths.metadata_filter(["type=function", "loose"], F.col("path"), F.col("language"))).select("chunk_idx")


# --- chunks ----------------------------------------------------------------------


def _long_files(spark, sf):
    """All documents of a source as one file each, one word a line, so that files have many windows."""
    return table(spark, sf, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.regexp_replace("text", " ", "\n").alias("text"))


@query
def chunk_windows(spark, sf):
    return chunk.line_windows(_long_files(spark, sf)).select("path", F.col("start_line").cast("long"), F.col("end_line").cast("long"), F.md5("snippet").alias("digest"))


@query
def chunk_build(spark, sf):
    built = chunk.build(chunk.line_windows(_long_files(spark, sf)))
    return built.select("path", F.col("start_line").cast("long"), F.octet_length("text").cast("long").alias("n_bytes"), "hash")


@query
def chunk_hash_dups(spark, sf):
    return chunks(spark, sf).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_idx").alias("first")).where("n > 1")


@query
def snippet12(spark, sf):
    body = F.concat(F.lit("// File: a/b\nimport x\n\n// Context: class Y\n"), F.regexp_replace("text", r"\. ", ".\n"))
    return chunks(spark, sf).select("chunk_idx", F.md5(text.snippet(body)).alias("digest"), F.length(text.snippet(body, full=True)).cast("long").alias("n_full"))


def _sources(spark, sf):
    """Two source files per nation, in Python and in Rust, with declarations on known lines."""
    k = F.col("n_nationkey").cast("string")
    text_of = lambda body: F.regexp_replace(F.lit(body), "#K", k)
    nations = table(spark, sf, "nation")
    rows = [
        nations.select(F.concat("n_name", F.lit(ending)).alias("path"), text_of(body).alias("text"), F.lit(lang).alias("language"))
        for ending, lang, body in ((".py", "python", sql.PYTHON), (".rs", "rust", sql.RUST))
    ]
    return rows[0].unionByName(rows[1]).withColumns({"graph_language": F.col("language"), "modified_at": F.lit(None).cast("timestamp"), "length": F.octet_length("text").cast("long")})


@query
def chunk_semantic(spark, sf):
    """Semantic chunks: where they begin and end, and the text that stands in front of them."""
    found = chunk.chunk_files(_sources(spark, sf))
    return found.select("path", F.col("start_line").cast("long"), F.col("end_line").cast("long"), F.octet_length("text").cast("long").alias("n_bytes"), "hash")


@query
def extract_symbols(spark, sf):
    s = repo.symbol_graph(_sources(spark, sf)).symbols
    return s.select("file_path", "name", "kind", F.col("start_line").cast("long"), F.col("end_line").cast("long"), "signature")


@query
def extract_edges(spark, sf):
    g = repo.symbol_graph(_sources(spark, sf))
    name = g.symbols.select("id", "name", "file_path")
    held = g.edges.join(name.toDF("source_id", "source", "path"), "source_id").join(name.select(F.col("id").alias("target_id"), F.col("name").alias("t")), "target_id", "left")
    return held.select("path", "source", "kind", F.coalesce("t", "metadata").alias("target"))


@query
def extract_imports(spark, sf):
    return repo.symbol_graph(_sources(spark, sf)).imports.select("source_file", "target_path", "alias", F.col("line").cast("long"))


@query
def ingest_filter(spark, sf):
    """Pages as files: not excluded, not binary, at most 5 MiB."""
    length = F.col("page_id") % 7 * (1 << 20)
    return _page_paths(spark, sf).where(paths.ingestible(F.col("path"), length)).select("page_id")


@query
def graph_language(spark, sf):
    return _page_paths(spark, sf).select("page_id", F.coalesce(paths.graph_language(F.col("path")), F.lit("none")).alias("language"))


@query
def limit_clamp(spark, sf):
    """A limit below one counts as one."""
    return rank.top(vecs(spark, sf).withColumn("score", F.lit(1.0)), 0, ties=("chunk_idx",)).select("chunk_idx")


# --- graph -------------------------------------------------------------------------


def _graph(spark, sf) -> graph.Graph:
    """Customers and suppliers as symbols of nation files, every order line as an edge, regions as imports."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    where = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("k"), F.concat("r_name", F.lit("/"), "n_name").alias("file_path"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("kind"), F.col("c_nationkey").alias("k"), (F.col("c_custkey") % 1000).alias("at"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("class").alias("kind"), F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 1000).alias("at"))
    symbols = c.unionByName(s).join(where, "k").select("id", "name", "kind", "file_path", (F.col("at") + 1).cast("int").alias("start_line"), (F.col("at") + 3).cast("int").alias("end_line"))
    o, line = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    edges = (
        o.join(line, o.o_orderkey == line.l_orderkey)
        .select(F.concat(F.lit("c"), "o_custkey").alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id"), F.when(F.col("o_orderstatus") == "F", "calls").otherwise("implements").alias("kind"))
        .withColumn("metadata", F.lit(None).cast("string"))
    )
    imports = where.select(F.col("file_path").alias("source_file"), F.split("file_path", "/")[0].alias("target_path"))
    return graph.Graph(symbols, edges, imports)


@query
def graph_callers(spark, sf):
    return _graph(spark, sf).callers("s1").groupBy("id", "name").agg(F.count(F.lit(1)).alias("n"))


@query
def graph_callees(spark, sf):
    return _graph(spark, sf).callees().groupBy("of_id", "id").agg(F.count(F.lit(1)).alias("n"))


@query
def graph_implementors(spark, sf):
    return _graph(spark, sf).implementors("s2").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query
def graph_edges_of(spark, sf):
    g = _graph(spark, sf)
    return g.outgoing("c1").unionByName(g.incoming("s1")).groupBy("source_id", "target_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query
def graph_prefix(spark, sf):
    return _graph(spark, sf).by_prefix("SUPPLIER#00000000").select("id", "name")


@query
def graph_definitions(spark, sf):
    g = _graph(spark, sf)
    return g.definitions("Customer#000000001").unionByName(g.of_kind("building")).unionByName(g.in_file("ASIA/CHINA")).select("id", "kind")


@query
def graph_importers(spark, sf):
    return _graph(spark, sf).importers("ASIA").select("source_file")


@query
def graph_stats(spark, sf):
    return _graph(spark, sf).stats()


def _asia(spark):
    return spark.createDataFrame([("ASIA/CHINA",), ("EUROPE/FRANCE",), ("nowhere",)], "path string")


@query
def graph_remove(spark, sf):
    return _graph(spark, sf).remove_files(_asia(spark)).stats()


@query
def graph_merge(spark, sf):
    g = _graph(spark, sf)
    return g.merge(g.remove_files(_asia(spark))).stats()


def _blocks(spark, sf):
    """Overlapping line ranges of every nation file."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    files = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("long").alias("k"), F.concat("r_name", F.lit("/"), "n_name").alias("path"))
    rows = files.select("k", "path", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("b"))
    return rows.select("path", (F.col("b") * 50 + 1).cast("int").alias("start_line"), (F.col("b") * 50 + 60).cast("int").alias("end_line"), (F.col("k") * 20 + F.col("b") + 1).alias("chunk_idx"))


@query
def symbol_in_chunk(spark, sf):
    return graph.symbols_in_chunks(_graph(spark, sf).symbols, _blocks(spark, sf)).select("symbol_id", "chunk_idx")


@query
def symbol_first_chunk(spark, sf):
    q = query_vector(spark, sf)
    with_vec = _blocks(spark, sf).join(vecs(spark, sf).drop("label"), "chunk_idx")
    return graph.first_chunk_results(_graph(spark, sf).symbols, with_vec, vectors.literal(q), 200).select("symbol_id", "chunk_idx", r6("score").alias("score"))


# --- maintenance ---------------------------------------------------------------------


def _cache(spark, sf):
    return chunks(spark, sf).where("chunk_idx % 3 = 0").select("hash", F.array(F.lit(1.0)).alias("vector"))


@query
def cache_hits(spark, sf):
    return incremental.hit_ratio(incremental.cache_join(chunks(spark, sf), _cache(spark, sf))).select("total", "hits", r6("ratio").alias("ratio"))


@query
def cache_misses(spark, sf):
    return incremental.misses(chunks(spark, sf), _cache(spark, sf)).select("chunk_idx")


@query
def files_complete(spark, sf):
    joined = incremental.cache_join(chunks(spark, sf), _cache(spark, sf)).withColumn("dir", paths.parent(F.col("path")))
    return incremental.completed_files(joined, "dir")


def _gone(spark):
    return spark.createDataFrame([("src1/en",), ("src2",), ("src3/fr/doc_3.py",), ("src",)], "path string")


@query
def delete_prefix(spark, sf):
    return incremental.delete_paths(chunks(spark, sf), _gone(spark)).select("chunk_idx")


@query
def apply_changes(spark, sf):
    c = chunks(spark, sf)
    touched = c.where("chunk_idx % 7 = 0").select("path", F.lit("touched").alias("op"))
    changes = _gone(spark).select("path", F.lit("deleted").alias("op")).unionByName(touched)
    fresh = c.where("chunk_idx % 14 = 0").withColumn("text", F.lit("new"))
    return incremental.apply_changes(c, changes, fresh).select("chunk_idx", F.length("text").cast("long").alias("n"))


def _events(spark, sf):
    """events as notifications over two paths each."""
    return _notifications(table(spark, sf, "events"))


def _notifications(rows):
    kind = F.get(F.array(*[F.lit(k) for k in sql.KINDS]), (F.col("event_id") % len(sql.KINDS)).cast("int"))
    path = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return rows.select("event_id", F.col("ts"), kind.alias("kind"), F.array(path, F.concat(path, F.lit("/x"))).alias("paths"))


@query
def event_categorize(spark, sf):
    return incremental.categorise(_events(spark, sf)).select("event_id", "path", "op")


@query
def debounce_sessions(spark, sf):
    found = incremental.sessions(incremental.categorise(_events(spark, sf)), gap="5 minutes")
    return found.select(F.unix_micros(F.col("started").cast("timestamp")).alias("started_us"), F.col("n_events").cast("long"))


@query
def dirty_sets(spark, sf):
    found = incremental.sessions(incremental.categorise(_events(spark, sf)), gap="5 minutes")
    return found.select(
        F.unix_micros(F.col("started").cast("timestamp")).alias("started_us"), F.size("touched").cast("long").alias("n_touched"), F.size("deleted").cast("long").alias("n_deleted"),
        F.array_join("deleted", ",").alias("deleted"),
    )


@query
def last_change(spark, sf):
    return incremental.last_event(incremental.categorise(_events(spark, sf)), order="event_id").select("path", "op", "event_id")


@query
def stream_sessions(spark, sf):
    """The debounced sessions of the event stream that a watermark has closed."""
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    rows = _notifications(stream).withColumn("ts", F.col("ts").cast("timestamp"))
    closed = incremental.sessions(incremental.categorise(rows).withWatermark("ts", "10 seconds"), gap="5 minutes")
    return watch.settled(closed.select(F.unix_micros("started").alias("started_us"), F.col("n_events").cast("long"), F.size("touched").cast("long").alias("n_touched")))


# --- remote --------------------------------------------------------------------------


@query
def remote_rank(spark, sf):
    q = vectors.literal(query_vector(spark, sf))
    hits = ann.exact(indexed(spark, sf), q, planner.remote_fetch_size(10)).withColumnRenamed("semantic", "score")
    names = spark.createDataFrame([("the",), ("Password",), ("absent",)], "name string")
    return planner.rank_remote(hits, QUERY, 10, names).select("chunk_idx", r6("score").alias("score"))


@query
def remote_rows(spark, sf):
    rows = chunks(spark, sf).select(F.col("hash").alias("id"), "chunk_idx", text.truncate_ellipsis(F.col("text"), 3800).alias("content"))
    return incremental.keep_first(rows, "id", "chunk_idx").select("id", "chunk_idx", F.octet_length("content").cast("long").alias("n_bytes"))
