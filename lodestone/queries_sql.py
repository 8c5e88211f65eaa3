"""DuckDB SQL for the queries in ``queries``."""

from __future__ import annotations

from .constants import BINARY_EXTENSIONS, DOC_PATHS, FILE_TYPES, GENERATED_PATHS, GRAPH_LANGUAGES, LANGUAGES, MAX_FILE_BYTES, PUNCTUATION, STOP_WORDS, SUFFIXES as STEMS, TEST_PATHS
from .functions.paths import default_excludes, glob_regex

QUERY = "the idiot password ontion scum les mentpa password"
EXT = {"en": ".rs", "fr": ".py", "de": ".md", "es": "_test.py"}
#: endings that turn the pages' URLs into paths of every class
SUFFIXES = ["/vendor/a.c", "/x_test.go", "/docs/y", "/main.py", "/z.min.js", "/README.md", "/lib.rs", "/SomeTest.java", "/tool.tar.gz", "/.bashrc", "/a.generated.ts"]
KINDS = ["create", "modify", "remove", "rename", "access"]

PYTHON = """import os
from a.b import c as d


class Box#K:
    def open(self):
        return helper#K(os)


def helper#K(x):
    return d(x)
"""
RUST = """use std::fmt as f;

struct Unit#K {
    n: i32,
}

impl Unit#K {
    fn grow(&self) -> i32 {
        scale#K(self.n)
    }
}

fn scale#K(x: i32) -> i32 {
    x * 2
}
"""

ORACLE_SQL: dict[str, str] = {}


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(map(quote, values)) + "]"


def tok(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}_]'), lambda w: strlen(w) >= 2)"


def kw(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]'), lambda w: strlen(w) >= 3 and not list_contains({strings(STOP_WORDS)}, w))"


def stem(w: str) -> str:
    cases = " ".join(f"when strlen({w}) > {len(s) + 2} and suffix({w}, '{s}') then left({w}, length({w}) - {len(s)})" for s in STEMS)
    return f"case {cases} else {w} end"


def file_stem(p: str) -> str:
    return rf"regexp_extract({p}, '([^/]+?)(\.[^./]*)?$', 1)"


CH = f"""ch as (select doc_id as chunk_idx, cast(doc_id as varchar) as id,
  source || '/' || lang || '/doc_' || doc_id || case lang {" ".join(f"when '{k}' then '{v}'" for k, v in EXT.items())} end as path,
  lang as language, text, sha256(text) as hash from documents)"""
IX = "ix as (select ch.*, embedding as vector from ch join embeddings on chunk_idx % (select count(*) from embeddings) = vec_id)"
QV = "(select embedding from embeddings where vec_id = 0)"


def plain(name: str, corpus: str) -> str:
    """CTE with plain BM25 of QUERY over ``corpus``."""
    return _bm25(name, corpus, f"select chunk_idx, unnest({tok('text')}) as term, 1.0 as w from {corpus}", f"select unnest({tok(quote(QUERY))}) as term")


def boosted(name: str, corpus: str, query: str) -> str:
    """CTEs with field-boosted BM25 of a query (an SQL string) over ``corpus``."""
    post = " union all ".join(
        f"select chunk_idx, unnest({tok(x)}) as t, {w} as w from {corpus}" for x, w in (("text", "1.0"), ("path", "1.0"), (file_stem("path"), "2.0"))
    )
    return _bm25(name, corpus, f"select chunk_idx, {stem('t')} as term, w from ({post})", f"select {stem('t')} as term from (select unnest({tok(query)}) as t)")


def with_symbols(name: str, corpus: str, query: str) -> str:
    """``boosted`` with the first three tokens of the text as symbols."""
    parts = [("text", "1.0"), ("path", "1.0"), (file_stem("path"), "2.0")]
    post = " union all ".join(f"select chunk_idx, unnest({tok(x)}) as t, {w} as w from {corpus}" for x, w in parts)
    post += f" union all select chunk_idx, unnest({tok('text')}[1:3]) as t, 2.0 as w from {corpus}"
    return _bm25(name, corpus, f"select chunk_idx, {stem('t')} as term, w from ({post})", f"select {stem('t')} as term from (select unnest({tok(query)}) as t)")


def _bm25(name: str, corpus: str, weighted: str, query: str) -> str:
    return f"""
{name}_p as (select chunk_idx, term, sum(w) as tf from ({weighted}) group by all),
{name}_l as (select c.chunk_idx, coalesce(sum(tf), 0) as dl from {corpus} c left join {name}_p p on p.chunk_idx = c.chunk_idx group by all),
{name}_s as (select count(*) as n, avg(dl) as avgdl, sum(dl) as total from {name}_l),
{name}_d as (select term, count(*) as df from {name}_p group by term),
{name}_q as (select term, count(*) as qtf from ({query}) group by term),
{name}_b as (select p.chunk_idx, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))) as bm25
  from {name}_p p join {name}_q q on p.term = q.term join {name}_d d on d.term = p.term join {name}_l l on l.chunk_idx = p.chunk_idx cross join {name}_s group by p.chunk_idx),
{name} as (select c.chunk_idx, coalesce(bm25, 0.0) as bm25 from {corpus} c left join {name}_b b on b.chunk_idx = c.chunk_idx)"""


def add(name: str, body: str) -> None:
    ORACLE_SQL[name] = body


add("tok_count", f"select doc_id as chunk_idx, cast(len({tok('text')}) as bigint) as n_tokens from documents")
add("tok_terms", f"select term, count(*) as n from (select unnest({tok('text')}) as term from documents) group by term")
add("kw_extract", f"select item_id, array_to_string({kw('text')}, ' ') as keywords from benchmark")
add("stem_terms", f"select distinct term, {stem('term')} as stem from (select unnest({tok('text')}) as term from documents)")
_MARKS = "[" + "".join("\\" + c for c in PUNCTUATION) + "]"
add("est_tokens", rf"select doc_id as chunk_idx, cast(greatest(1, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) + len(regexp_extract_all(text, {quote(_MARKS)}))) as bigint) as n_tokens from documents")

_P, _B = f"with {CH}, {plain('m', 'ch')}", f"with {CH}, {boosted('m', 'ch', quote(QUERY))}"
add("bm25_plain", f"{_P} select chunk_idx, round(bm25, 6) as score from m where bm25 > 0")
add("bm25_topk", f"{_P} select chunk_idx, round(bm25, 6) as score from m where bm25 > 0 order by score desc, chunk_idx limit 10")
add("bm25f_fields", f"{_B} select chunk_idx, round(bm25, 6) as score from m")
add("bm25f_symbols", f"with {CH}, {with_symbols('m', 'ch', quote(QUERY))} select chunk_idx, round(bm25, 6) as score from m")
add("bm25f_topk", f"{_B} select chunk_idx, round(bm25, 6) as score from m where bm25 > 0 order by score desc, chunk_idx limit 10")
add("bm25f_postings", f"{_B} select chunk_idx, round(bm25, 6) as score from m where bm25 > 0")
add("bm25_norm", f"{_P}, r as (select min(bm25) as lo, max(bm25) as hi from m) select chunk_idx, round(case when hi - lo < 1.1920929e-07 then 0.5 else (bm25 - lo) / (hi - lo) end, 6) as score from m, r")
add("corpus_stats", f"{_B} select cast(n as bigint) as n, round(cast(avgdl as double), 6) as avgdl, cast(total as bigint) as total from m_s")
add("doc_freq_top", f"{_B} select term, df from m_d order by df desc, term limit 50")

_COS = f"list_cosine_similarity(cast(embedding as double[]), cast({QV} as double[]))"
add("cosine_topk", f"select vec_id as chunk_idx, round({_COS}, 6) as score from embeddings order by score desc, chunk_idx limit 10")
add("cosine_arrow", f"select vec_id as chunk_idx, round({_COS}, 6) as score from embeddings")
add("ann_oversample", f"select vec_id as chunk_idx, round({_COS}, 6) as score from embeddings order by score desc, chunk_idx limit 40")
_BITS = "cast(list_sum(list_transform(range(1, 65), lambda i: case when embedding[i] > 0 then (case when i = 64 then cast(-9223372036854775808 as hugeint) else cast(1 as hugeint) << (i - 1) end) else cast(0 as hugeint) end)) as bigint)"
add("quantize_bits", f"select vec_id as chunk_idx, cast({_BITS} as varchar) as bits from embeddings")
_HAM = f"list_sum(list_transform(list_zip(embedding, {QV}), lambda p: case when (p[1] > 0) = (p[2] > 0) then 0 else 1 end))"
add("hamming_topk", f"select vec_id as chunk_idx, cast({_HAM} as bigint) as distance from embeddings order by distance, chunk_idx limit 20")
add("two_phase_topk", f"with s as (select * from embeddings order by {_HAM}, vec_id limit 100) select vec_id as chunk_idx, round({_COS}, 6) as score from s order by score desc, chunk_idx limit 10")
add("ann_cells", "select vec_id as chunk_idx, true as placed from embeddings")
add("l2_norm", """select vec_id as chunk_idx, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) as norm, round(u[1], 6) as first from (
  select vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as u from (select vec_id, list_transform(cast(embedding as double[]), lambda x: x * 3) as v from embeddings))""")
add("dim_truncate", "select vec_id as chunk_idx, cast(16 as bigint) as dim, round(sqrt(list_sum(list_transform(cast(embedding[1:16] as double[]), lambda x: x * x))), 6) as norm from embeddings")

_FILES = """fr as (select 'dir' || (label % 3) || '/f' || label as path, cast(embedding as double[]) as v from embeddings),
fp as (select path, i, avg(v[i]) as m, count(*) as n from (select path, v, unnest(range(1, 65)) as i from fr) group by all),
fm as (select path, list(m order by i) as m, max(n) as chunk_count, sqrt(sum(m * m)) as nn from fp group by path),
files as (select path, list_transform(m, lambda x: x / nn) as vector, chunk_count from fm)"""
_DIRS = """dp as (select regexp_replace(path, '/?[^/]*$', '') as path, vector as v, chunk_count from files),
dq as (select path, i, avg(v[i]) as m, count(*) as n, sum(chunk_count) as c from (select path, v, chunk_count, unnest(range(1, 65)) as i from dp) group by all),
dm as (select path, list(m order by i) as m, max(n) as file_count, cast(max(c) as bigint) as chunk_count, sqrt(sum(m * m)) as nn from dq group by path),
dirs as (select path, list_transform(m, lambda x: x / nn) as vector, file_count, chunk_count from dm)"""
_VCOS = f"round(list_cosine_similarity(vector, cast({QV} as double[])), 6)"
add("file_rollup", f"with {_FILES} select path, chunk_count, round(vector[1], 6) as v1, round(sqrt(list_sum(list_transform(vector, lambda x: x * x))), 6) as norm from files")
add("dir_rollup", f"with {_FILES}, {_DIRS} select path, file_count, chunk_count, round(vector[1], 6) as v1 from dirs")
add("search_files", f"with {_FILES} select path, chunk_count, {_VCOS} as score from files order by score desc, path limit 5")
add("search_dirs", f"with {_FILES}, {_DIRS} select path, file_count, chunk_count, {_VCOS} as score from dirs order by score desc, path limit 5")


def rlike(p: str, patterns: list[str]) -> str:
    return f"regexp_matches({p}, {quote('(?i)' + '|'.join(patterns))})"


def file_type(p: str) -> str:
    return f"case when {rlike(p, GENERATED_PATHS)} then 'generated' when {rlike(p, TEST_PATHS)} then 'test' when {rlike(p, DOC_PATHS)} then 'documentation' else 'implementation' end"


def factor(p: str) -> str:
    return f"case {file_type(p)} " + " ".join(f"when '{k}' then cast({v} as double)" for k, v in FILE_TYPES.items()) + " end"


def one_pass(name: str, query: str, candidates: str) -> str:
    """CTEs that end in ``name(chunk_idx, bm25, semantic, score)`` over the chosen rows of ix."""
    return f"""{boosted(name + '_m', 'ix', query)},
{name}_c as (select ix.*, bm25, list_cosine_similarity(cast(vector as double[]), cast({QV} as double[])) as semantic from ix join {name}_m using (chunk_idx) where {candidates}),
{name}_r as (select min(bm25) as lo, max(bm25) as hi from {name}_c),
{name} as (select {name}_c.*, 0.85 * semantic + 0.15 * (case when hi - lo < 1.1920929e-07 then 0.5 else (bm25 - lo) / (hi - lo) end) as score from {name}_c, {name}_r)"""


def feedback(best: str) -> str:
    return f"""fb as (select term, count(*) as n from (select unnest({tok('text')}) as term from {best}) where strlen(term) >= 3 and not list_contains({kw(quote(QUERY))}, term) group by term),
ft as (select term, n from (select * from fb order by n desc, term limit 5) where n >= 2),
xq as (select {quote(QUERY)} || coalesce(' ' || string_agg(term, ' ' order by n desc, term), '') as q from ft)"""


def two_pass(candidates: str = "true") -> str:
    """CTEs that end in ``best`` (first pass), ``two`` and ``merged``."""
    return f"""with recursive {CH}, {IX}, {one_pass('one', quote(QUERY), candidates)},
best as (select * from one order by round(score, 6) desc, path, id limit 10), {feedback('best')},
{one_pass('two', '(select q from xq)', candidates)},
merged as (select chunk_idx, arg_max(score, (score, -pass)) as score, arg_max(semantic, (score, -pass)) as semantic, arg_max(bm25, (score, -pass)) as bm25
  from (select chunk_idx, score, semantic, bm25, 0 as pass from best union all select chunk_idx, score, semantic, bm25, 1 from two) group by chunk_idx)"""


def greedy(rows: str, threshold: float) -> str:
    """CTEs: ``rows(chunk_idx, hash, vector, o)`` in order o, kept greedily as ``kept``."""
    return f"""u as (select *, row_number() over (order by o) as k from (select *, row_number() over (partition by hash order by o) as h from {rows}) where h = 1),
g(k, ids, vecs) as (select cast(0 as bigint), cast([] as bigint[]), cast([] as double[][])
  union all select g.k + 1,
    case when len(list_filter(g.vecs, lambda v: list_cosine_similarity(v, cast(u.vector as double[])) > {threshold})) > 0 then g.ids else list_append(g.ids, u.chunk_idx) end,
    case when len(list_filter(g.vecs, lambda v: list_cosine_similarity(v, cast(u.vector as double[])) > {threshold})) > 0 then g.vecs else list_append(g.vecs, cast(u.vector as double[])) end
  from g join u on u.k = g.k + 1),
kept as (select unnest(ids) as chunk_idx from g where k = (select max(k) from g))"""


def hybrid(candidates: str = "true") -> str:
    return f"""{two_pass(candidates)},
ranked as (select m.chunk_idx, m.score * {factor('path')} as score, semantic, bm25, path, ix.id, hash, vector from merged m join ix using (chunk_idx)),
lim as (select *, row_number() over (order by round(score, 6) desc, path, id) as o from ranked order by o limit 10),
{greedy('lim', 0.95)}
select chunk_idx, round(score, 6) as score, round(semantic, 6) as semantic, round(bm25, 6) as bm25 from lim join kept using (chunk_idx)"""


_QHAM = f"list_sum(list_transform(list_zip(vector, {QV}), lambda p: case when (p[1] > 0) = (p[2] > 0) then 0 else 1 end))"
add("hybrid_linear", hybrid())
add("hybrid_filtered", hybrid("(starts_with(path, 'src1/') or starts_with(path, 'src0/')) and lower(language) = 'en' and contains(lower(path), 'doc_')"))
add("hybrid_hnsw", hybrid(f"chunk_idx in (select chunk_idx from ix order by round(list_cosine_similarity(cast(vector as double[]), cast({QV} as double[])), 6) desc, chunk_idx limit 40)"))
add("hybrid_binary", hybrid(f"chunk_idx in (select chunk_idx from ix order by {_QHAM}, chunk_idx limit 100)"))
_PICK = "case when n >= 1000 then 'binary' when n >= 500 then 'ann' else 'linear' end"
add("strategy_pick", f"select cast(n as varchar) as n, {_PICK} as plain, 'linear' as filtered from (select unnest([1, 499, 500, 999, 1000, 100000]) as n) union all select 'corpus', {_PICK}, 'linear' from (select count(*) as n from documents)")
add("prf_terms", f"{two_pass()} select term, n from ft")
add("prf_expanded_query", f"{two_pass()} select q as expanded from xq")
add("prf_two_pass", f"{two_pass()} select chunk_idx, round(score, 6) as score from merged")
add("dedup_hash", "select chunk_idx from (select doc_id as chunk_idx, row_number() over (partition by sha256(text) order by length(text) desc, doc_id) as k from documents) where k = 1")
add("dedup_semantic", f"with recursive s as (select vec_id as chunk_idx, cast(vec_id % 50 as varchar) as hash, embedding as vector, row_number() over (order by round({_COS}, 6) desc, vec_id) as o from embeddings order by o limit 60), {greedy('s', 0.3)} select chunk_idx from kept")

PG = f"pg as (select page_id, regexp_replace(url, '^[a-z]+://', '') || {strings(SUFFIXES)}[page_id % {len(SUFFIXES)} + 1] as path from pages)"
add("file_type_class", f"with {PG} select page_id, {file_type('path')} as file_type from pg")
add("file_type_priority", f"with {PG} select page_id, {factor('path')} as factor from pg")
_EXT = r"lower(regexp_extract(string_split(path, '/')[-1], '^.+\.([^.]*)$', 1))"
_LANG = "case " + " ".join(f"when {_EXT} in ({', '.join(map(quote, exts.split()))}) then '{label}'" for label, exts in LANGUAGES.items()) + " else 'plain' end"
add("path_parts", f"with {PG} select page_id, {file_stem('path')} as stem, regexp_replace(path, '/?[^/]*$', '') as parent, {_LANG} as language from pg")
add("glob_any", f"with {PG} select page_id from pg where regexp_matches(path, '^(.*/)?.*[.]py$') or regexp_matches(path, '^.*1/docs/.*$')")
add("filter_lang", "select doc_id as chunk_idx from documents where lower(lang) = 'fr'")
add("filter_path", f"with {CH} select chunk_idx from ch where contains(lower(path), 'src1') and contains(lower(path), 'doc_1')")
add("filter_unknown", "select doc_id as chunk_idx from documents")

_WIN = """f as (select source || '/' || doc_id as path, regexp_split_to_array(replace(text, ' ', chr(10)), '\\r?\\n') as l0 from documents),
fl as (select path, case when l0[-1] = '' then l0[1:len(l0) - 1] else l0 end as l from f),
w as (select path, case when len(l) = 0 then 1 else s + 1 end as start_line, least(s + 400, len(l)) as end_line, array_to_string(l[s + 1:s + 400], chr(10)) as snippet
  from (select path, l, unnest(range(0, greatest(len(l), 1), 400)) as s from fl))"""
add("chunk_windows", f"with {_WIN} select path, cast(start_line as bigint) as start_line, cast(end_line as bigint) as end_line, md5(snippet) as digest from w")

add("chunk_build", f"""with {_WIN}, t as (select path, start_line, '// File: ' || path || chr(10) || regexp_replace(snippet, '^\\s+|\\s+$', '', 'g') as body from w),
c as (select path, start_line, body, case when strlen(body) <= 8192 then length(body) else
  (select max(i) from (select unnest(range(1, length(body) + 1)) as i) where strlen(left(body, i)) <= 8192) end as n from t)
select path, cast(start_line as bigint) as start_line, cast(strlen(left(body, n)) as bigint) as n_bytes, sha256(left(body, n)) as hash from c""")
add("chunk_hash_dups", "select sha256(text) as hash, count(*) as n, min(doc_id) as first from documents group by all having count(*) > 1")
add("snippet12", """with b as (select doc_id, replace(text, '. ', '.' || chr(10)) as t from documents),
s as (select doc_id, t, string_split(t, chr(10)) as l0 from b), l as (select doc_id, t, case when l0[-1] = '' then l0[1:len(l0) - 1] else l0 end as l from s)
select doc_id as chunk_idx, md5(array_to_string(l[1:12], chr(10))) as digest, length(t) as n_full from l""")



def per_nation(columns: str, rows: list[tuple]) -> str:
    """The rows for every nation, with its key for #K and its name for #N."""
    values = ", ".join("(" + ", ".join("null" if x is None else str(x) if isinstance(x, int) else quote(x) for x in r) + ")" for r in rows)
    names = columns.split()
    filled = ", ".join(f"replace(replace({c}, '#K', cast(n_nationkey as varchar)), '#N', n_name) as {c}" if any(isinstance(r[i], str) for r in rows) else f"cast({c} as bigint) as {c}" for i, c in enumerate(names))
    return f"select {filled} from nation, (values {values}) as t({', '.join(names)})"


_LEAD_PY, _LEAD_RS = "import os\nfrom a.b import c as d\n\n", "use std::fmt as f;\n\n"
_PY_LINES, _RS_LINES = PYTHON.split("\n"), RUST.split("\n")
_UNIT = "\n".join(_RS_LINES[2:5])
_CHUNKS = [
    ("#N.py", 6, 11, _LEAD_PY + "// Context: class Box#K\n" + "\n".join(_PY_LINES[5:7]) + "\n\n" + "\n".join(_PY_LINES[9:11])),
    ("#N.rs", 3, 5, _LEAD_RS + _UNIT),
    ("#N.rs", 8, 15, _LEAD_RS + "// Context: impl Unit#K\n" + "\n".join(_RS_LINES[7:10]) + "\n\n" + "\n".join(_RS_LINES[12:15])),
]
add("chunk_semantic", f"""select path, start_line, end_line, cast(strlen(t) as bigint) as n_bytes, sha256(t) as hash from (
  select path, start_line, end_line, '// File: ' || path || chr(10) || regexp_replace(body, '^\\s+|\\s+$', '', 'g') as t from ({per_nation("path start_line end_line body", _CHUNKS)}))""")
add("extract_symbols", per_nation("file_path name kind start_line end_line signature", [
    ("#N.py", "Box#K", "class", 5, 7, "class Box#K:"), ("#N.py", "open", "function", 6, 7, "def open(self):"), ("#N.py", "helper#K", "function", 10, 11, "def helper#K(x):"),
    ("#N.rs", "Unit#K", "struct", 3, 5, "struct Unit#K {"), ("#N.rs", "Unit#K", "struct", 7, 11, "impl Unit#K {"), ("#N.rs", "grow", "function", 8, 10, "fn grow(&self) -> i32 {"),
    ("#N.rs", "scale#K", "function", 13, 15, "fn scale#K(x: i32) -> i32 {"),
]))
add("extract_edges", per_nation("path source kind target", [
    ("#N.py", "Box#K", "contains", "open"), ("#N.py", "Box#K", "calls", "helper#K"), ("#N.py", "open", "calls", "helper#K"), ("#N.py", "helper#K", "calls", "d"),
    ("#N.rs", "Unit#K", "contains", "grow"), ("#N.rs", "Unit#K", "calls", "scale#K"), ("#N.rs", "grow", "calls", "scale#K"),
]))
add("extract_imports", per_nation("source_file target_path alias line", [("#N.py", "os", None, 1), ("#N.py", "a.b", "d", 2), ("#N.rs", "std::fmt as f", "f", 1)]))
_SUFFIX = r"regexp_extract(string_split(path, '/')[-1], '^.+\.([^.]*)$', 1)"
_SKIP = quote("(?s)" + "|".join(f"(?:{g})" for g in map(glob_regex, default_excludes()) if g))
add("ingest_filter", f"with {PG} select page_id from pg where not regexp_matches(path, {_SKIP}) and not list_contains({strings(BINARY_EXTENSIONS)}, {_SUFFIX}) and lower({_SUFFIX}) <> 'min' and page_id % 7 * 1048576 <= {MAX_FILE_BYTES}")
_GLANG = "case " + " ".join(f"when {_EXT} in ({', '.join(map(quote, exts.split()))}) then '{label}'" for label, exts in GRAPH_LANGUAGES.items()) + " else 'none' end"
add("graph_language", f"with {PG} select page_id, {_GLANG} as language from pg")
add("limit_clamp", "select min(vec_id) as chunk_idx from embeddings")

_G = """wh as (select n_nationkey as k, r_name || '/' || n_name as file_path from nation join region on n_regionkey = r_regionkey),
sy as (select id, name, kind, file_path, cast(line + 1 as integer) as start_line, cast(line + 3 as integer) as end_line from (
  select 'c' || c_custkey as id, c_name as name, lower(c_mktsegment) as kind, c_nationkey as k, c_custkey % 1000 as line from customer
  union all select 's' || s_suppkey, s_name, 'class', s_nationkey, s_suppkey % 1000 from supplier) join wh using (k)),
ed as (select 'c' || o_custkey as source_id, 's' || l_suppkey as target_id, case when o_orderstatus = 'F' then 'calls' else 'implements' end as kind from orders join lineitem on o_orderkey = l_orderkey),
im as (select file_path as source_file, split_part(file_path, '/', 1) as target_path from wh)"""


def stats(s: str, e: str, i: str) -> str:
    return f"""select 'symbols' as metric, count(*) as value from {s} union all select 'files', count(distinct file_path) from {s} union all select 'edges', count(*) from {e}
union all select 'imports', count(*) from {i} union all select 'kind:' || kind, count(*) from {s} group by kind"""


_RM = """rs as (select * from sy where file_path not in ('ASIA/CHINA', 'EUROPE/FRANCE', 'nowhere')), dead as (select id from sy where file_path in ('ASIA/CHINA', 'EUROPE/FRANCE', 'nowhere')),
re as (select * from ed where source_id not in (select id from dead) and target_id not in (select id from dead)), ri as (select * from im where source_file not in ('ASIA/CHINA', 'EUROPE/FRANCE', 'nowhere'))"""
_BL = """bl as (select path, start_line, end_line, chunk_idx from (select file_path as path, b * 50 + 1 as start_line, b * 50 + 60 as end_line, cast(k * 20 + b + 1 as bigint) as chunk_idx from wh, (select unnest(range(0, 20)) as b)))"""
_SIC = "select s.id as symbol_id, b.chunk_idx from {0} s join bl b on s.file_path = b.path and b.start_line <= s.start_line and s.end_line <= b.end_line"
add("graph_callers", f"with {_G} select sy.id, sy.name, count(*) as n from ed join sy on ed.source_id = sy.id where ed.kind = 'calls' and target_id = 's1' group by all")
add("graph_callees", f"with {_G} select source_id as of_id, sy.id, count(*) as n from ed join sy on ed.target_id = sy.id where ed.kind = 'calls' group by all")
add("graph_implementors", f"with {_G} select sy.id, count(*) as n from ed join sy on ed.source_id = sy.id where ed.kind = 'implements' and target_id = 's2' group by all")
add("graph_edges_of", f"with {_G} select source_id, target_id, kind, count(*) as n from (select * from ed where source_id = 'c1' union all select * from ed where target_id = 's1') group by all")
add("graph_prefix", f"with {_G} select id, name from sy where starts_with(lower(name), 'supplier#00000000')")
add("graph_definitions", f"with {_G} select id, kind from sy where name = 'Customer#000000001' union all select id, kind from sy where kind = 'building' union all select id, kind from sy where file_path = 'ASIA/CHINA'")
add("graph_importers", f"with {_G} select source_file from im where contains(target_path, 'ASIA') or contains('ASIA', target_path)")
add("graph_stats", f"with {_G} {stats('sy', 'ed', 'im')}")
add("graph_remove", f"with {_G}, {_RM} {stats('rs', 're', 'ri')}")
add("graph_merge", f"with {_G}, {_RM}, ms as (select * from sy union all select * from rs), me as (select * from ed union all select * from re), mi as (select * from im union all select * from ri) {stats('ms', 'me', 'mi')}")
add("symbol_in_chunk", f"with {_G}, {_BL} {_SIC.format('sy')}")
add("symbol_first_chunk", f"""with {_G}, {_BL}, fs as (select * from sy order by id limit 200),
x as (select symbol_id, min(z.chunk_idx) as chunk_idx from ({_SIC.format('fs')}) z join embeddings on vec_id = z.chunk_idx group by symbol_id)
select symbol_id, chunk_idx, round(0.8 + 0.2 * {_COS}, 6) as score from x join embeddings on vec_id = chunk_idx""")

_KNOWN = "select distinct hash from ch where chunk_idx % 3 = 0"
add("cache_hits", f"with {CH}, j as (select hash in ({_KNOWN}) as hit from ch) select count(*) as total, cast(count(*) filter (hit) as bigint) as hits, round(count(*) filter (hit) / count(*), 6) as ratio from j")
add("cache_misses", f"with {CH} select chunk_idx from ch where hash not in ({_KNOWN})")
add("files_complete", f"with {CH} select regexp_replace(path, '/?[^/]*$', '') as dir, bool_and(hash in ({_KNOWN})) as complete, count(*) as chunks from ch group by all")
_GONE = "gone as (select unnest(['src1/en', 'src2', 'src3/fr/doc_3.py', 'src']) as g)"
_ALIVE = "not exists (select 1 from gone where path = g or starts_with(path, g || '/'))"
add("delete_prefix", f"with {CH}, {_GONE} select chunk_idx from ch where {_ALIVE}")
add("apply_changes", f"with {CH}, {_GONE} select chunk_idx, length(text) as n from ch where {_ALIVE} and chunk_idx % 7 <> 0 union all select chunk_idx, 3 from ch where chunk_idx % 14 = 0")

_EV = f"""ev as (select event_id, ts, {strings(KINDS)}[event_id % 5 + 1] as kind, 'u' || user_id as p from events),
cg as (select event_id, ts, p || case i when 0 then '' else '/x' end as path, case when kind = 'remove' or (kind = 'rename' and i = 0) then 'deleted' else 'touched' end as op
  from ev, (select unnest([0, 1]) as i) where kind <> 'access')"""
_SE = """se as (select *, sum(fresh) over (order by ts, event_id, path rows unbounded preceding) as s from (select *, case when ts <= lag(ts) over (order by ts, event_id, path) + interval 5 minutes then 0 else 1 end as fresh from cg))"""
add("event_categorize", f"with {_EV} select event_id, path, op from cg")
add("debounce_sessions", f"with {_EV}, {_SE} select epoch_us(min(ts)) as started_us, count(*) as n_events from se group by s")
add("dirty_sets", f"with {_EV}, {_SE} select epoch_us(min(ts)) as started_us, count(distinct path) filter (op = 'touched') as n_touched, count(distinct path) filter (op = 'deleted') as n_deleted, coalesce(string_agg(distinct path, ',' order by path) filter (op = 'deleted'), '') as deleted from se group by s")
add("stream_sessions", f"""with {_EV}, {_SE} select epoch_us(min(ts)) as started_us, count(*) as n_events, count(distinct path) filter (op = 'touched') as n_touched from se
group by s having max(ts) + interval 5 minutes <= (select max(ts) from cg) - interval 10 seconds""")
add("last_change", f"with {_EV} select path, op, event_id from (select *, row_number() over (partition by path order by ts desc, event_id desc) as k from cg) where k = 1")

add("remote_rank", f"""with {CH}, {IX}, hs as (select *, list_cosine_similarity(cast(vector as double[]), cast({QV} as double[])) as semantic from ix), hits as (select * from hs order by round(semantic, 6) desc, chunk_idx limit 40),
{boosted('m', 'hits', quote(QUERY))}
select chunk_idx, round((0.85 * semantic + 0.15 * least(1.0, bm25 / 10)) * case when contains(lower(text), 'the') then 1.1 else 1.0 end * {factor('path')}, 6) as score
from hits join m using (chunk_idx) order by score desc, path, id limit 10""")
add("remote_rows", f"""with {CH}, r as (select hash as id, chunk_idx, text from (select *, row_number() over (partition by hash order by chunk_idx) as k from ch) where k = 1)
select id, chunk_idx, cast(case when strlen(text) <= 3800 then strlen(text) else 3 + (select max(strlen(left(text, i))) from (select unnest(range(1, length(text) + 1)) as i) where strlen(left(text, i)) <= 3797) end as bigint) as n_bytes from r""")
