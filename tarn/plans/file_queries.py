"""Files, chunks, symbols and code over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import fixed, text
from tarn.functions.frames import spread
from tarn.operators import chunks, code_chunks, code_intel, repositories, symbols
from tarn.plans.code_queries import source_files
from tarn.plans.register import query
from tarn.session import table

LINES = "case when coalesce(text, '') = '' then []::varchar[] else string_split_regex(regexp_replace(text, '\\r?\\n$', ''), '\\r?\\n') end"
EXTENSIONS = ("rs", "py", "js", "jsx", "ts", "tsx", "go", "rb", "md", "yaml", "html", "h", "zz")
_EXTS = "[" + ", ".join(f"'{e}'" for e in EXTENSIONS) + "]"
_PATHS = f"paths as (select doc_id, source || '/' || case doc_id % 7 when 0 then 'main' when 1 then 'test_' when 2 then 'app_config' else 'file' end || doc_id || '.' || {_EXTS}[1 + doc_id % {len(EXTENSIONS)}] file_path, text, lang, n_chars from documents)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files of many kinds."""
    docs = _documents(spark, sf_dir)
    name = F.when(F.col("doc_id") % 7 == 0, "main").when(F.col("doc_id") % 7 == 1, "test_").when(F.col("doc_id") % 7 == 2, "app_config").otherwise("file")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (1 + F.col("doc_id") % len(EXTENSIONS)).cast("int"))
    return docs.select("doc_id", F.concat("source", F.lit("/"), name, F.col("doc_id").cast("string"), F.lit("."), ext).alias("file_path"), "text", "lang", "n_chars")


@query(f"""with l as (select doc_id, {LINES} l from documents), b as (select doc_id, l, unnest(generate_series(0, (len(l) + 4) // 5 - 1)) i from l where len(l) > 0)
    select doc_id, (i * 5 + 1)::int start_line, least((i + 1) * 5, len(l))::int end_line, 'fallback_chunk_' || i element_type, 'fallback' as language, sha256(array_to_string(l[i * 5 + 1:i * 5 + 5], chr(10))) content from b
    union all select doc_id, 1, 1, 'fallback_chunk', 'fallback', sha256('') from l where len(l) = 0""")
def chunk_lines_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.fallback_chunks(_documents(spark, sf_dir).select("doc_id", "text"), size=5)
    return found.withColumn("content", F.sha2("content", 256))


_KIND = """case when contains(c, 'fn ') or contains(c, 'function ') or contains(c, 'def ') then 'function' when contains(c, 'class ') then 'class' when contains(c, 'struct ') then 'struct'
    when contains(c, 'enum ') then 'enum' when contains(c, 'interface ') then 'interface' when contains(c, 'impl ') then 'impl' when contains(c, 'import ') or contains(c, 'use ') then 'import' else 'block' end"""


@query(f"""with l as (select doc_id, {LINES} l from documents), b as (select doc_id, l, unnest(generate_series(0, (len(l) + 9) // 10 - 1)) i from l where len(l) > 0),
    t as (select doc_id, (i * 10 + 1)::int start_line, least((i + 1) * 10, len(l))::int end_line, array_to_string(l[i * 10 + 1:i * 10 + 10], chr(10)) c from b)
    select doc_id, start_line, end_line, {_KIND} element_type from t where trim(c) <> ''""")
def chunk_lines_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.simple_chunks(_documents(spark, sf_dir).select("doc_id", "text"), size=10).drop("content")


@query(f"""with l as (select page_id, {LINES.replace('text', 'html')} l from pages), b as (select page_id, l, unnest(generate_series(0, (len(l) + 19) // 20 - 1)) i from l where len(l) > 0)
    select page_id, 'html' as language, count(*) n, max(least((i + 1) * 20, len(l)))::int n_lines from b group by page_id""")
def html_fallback_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.html_chunks(table(spark, sf_dir, "pages").select("page_id", "html"), size=20)
    return found.groupBy("page_id", "language").agg(F.count("*").alias("n"), F.max("end_line").alias("n_lines"))


@query(f"with l as (select doc_id, {LINES} l from documents) select doc_id, array_to_string(l[2:4], chr(10)) part from l")
def read_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", text.range_of_lines(F.col("text"), 2, 4).alias("part"))


@query(f"""with l as (select doc_id, {LINES} l from documents), n as (select doc_id, len(l) n, list_transform(generate_series(2, least(len(l), 9)), lambda i: printf('%4d %s %s', i, case when i between 5 and 6 then '|' else ':' end, l[i])) s from l)
    select doc_id, array_to_string(['...'] || s || case when n > 9 then ['...'] else []::varchar[] end, chr(10)) snippet from n""")
def snippet_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", text.snippet(F.col("text"), 5, 6).alias("snippet"))


_LANG = "case regexp_extract(file_path, '[^/]\\.([^./]+)$', 1) " + " ".join(f"when '{k}' then '{v}'" for k, v in fixed.PARSER_LANGUAGES.items()) + " else 'fallback' end"


@query(f"with {_PATHS} select file_path, {_LANG} as language, regexp_extract(file_path, '[^/]\\.([^./]+)$', 1) ext from paths")
def language_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("file_path")
    return _files(spark, sf_dir).select("file_path", text.parser_language(path).alias("language"), text.extension(path).alias("ext"))


_ELEMENTS = [("function", None), ("type", "go"), ("type", "rust"), ("h2_section", "markdown"), ("root_content", None), ("h3_section_split_1", None), ("fallback_chunk_3", None), ("fallback_chunk", None), ("document", "yaml"), ("const", "go"), ("var", "go"), ("impl", "rust"), ("singleton_method", "ruby")]


@query(
    "with t as (select doc_id, [" + ", ".join(f"'{e}'" for e, _ in _ELEMENTS) + f"][1 + doc_id % {len(_ELEMENTS)}] e, [" + ", ".join("null" if lang is None else f"'{lang}'" for _, lang in _ELEMENTS) + f"][1 + doc_id % {len(_ELEMENTS)}] l from documents) "
    "select doc_id, e element_type, coalesce(e in ('function', 'method', 'struct', 'class', 'enum', 'interface', 'trait', 'module', 'const', 'constant') or (e = 'type' and l is not null and l = 'go') or regexp_matches(e, '^h.*_section$') or starts_with(e, 'root_') or contains(e, '_section_split_') or starts_with(e, 'fallback_chunk_'), false) core, l as language from t"
)
def core_element_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as elements of all kinds in turn."""
    of = lambda k: F.get(F.array(*(F.lit(x[k]) for x in _ELEMENTS)).cast("array<string>"), (F.col("doc_id") % len(_ELEMENTS)).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", of(0).alias("element_type"), of(1).alias("language"))
    return rows.withColumn("core", text.core_element(F.col("element_type"), F.col("language")))


@query(f"""with {_PATHS} select file_path, regexp_full_match(file_path, '(?:.*/)?main[^/]*\\.[jt]sx?') deep, regexp_full_match(regexp_extract(file_path, '[^/]*$'), '[^/]*\\.py') py,
    regexp_full_match(lower(file_path), 'src1[0-9]/[^/]*\\.(go)') one from paths""")
def glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("file_path")
    deep = text.glob_match(path, "**/main*.js") | text.glob_match(path, "**/main*.jsx") | text.glob_match(path, "**/main*.ts") | text.glob_match(path, "**/main*.tsx")
    return _files(spark, sf_dir).select("file_path", deep.alias("deep"), text.glob_match(path, "*.py").alias("py"), text.glob_match(path, "SRC1[0-9]/*.go", case_sensitive=False).alias("one"))


@query(f"with {_PATHS} select lower(regexp_extract(file_path, '[^/]\\.([^./]+)$', 1)) ext, count(*) n, sum(n_chars)::bigint size from paths group by ext")
def ext_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repositories.extension_statistics(_files(spark, sf_dir), size="n_chars")


@query("select page_id, regexp_matches(url, '(^|/)\\.') hidden, regexp_matches(url, '(^|/)target/') in_target, " + " or ".join(f"contains(url, '{x}')" for x in fixed.MAP_IGNORED) + " ignored from pages")
def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.hidden(url).alias("hidden"), text.in_target(url).alias("in_target"), text.ignored_by_map(url).alias("ignored"))


_CONTEXT = f"l as (select doc_id, {LINES} l from documents), r as (select doc_id, l, unnest(generate_series(1, len(l))) i from l)"


@query(f"with {_CONTEXT} select doc_id, i::int line_number, sha256(array_to_string(l[greatest(i - 2, 1):i + 2], chr(10))) context from r")
def line_context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = symbols.contextual_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "line_number", F.sha2("context", 256).alias("context"))


# every seventh line of a text becomes a comment
_COMMENTED = "c as (select doc_id, i, case when i % 7 = 3 then '// ' || l[i] else l[i] end x from r)"


def _commented(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.transform(text.lines(F.col("text")), lambda x, i: F.when((i + 1) % 7 == 3, F.concat(F.lit("// "), x)).otherwise(x))
    return _documents(spark, sf_dir).select("doc_id", F.array_join(marked, "\n").alias("text"))


@query(f"""with {_CONTEXT}, {_COMMENTED}, d as (select doc_id, i, case when regexp_matches(x, '^\\s*(?://|#|/\\*|\\*|\"\"\")') then trim(regexp_replace(x, '^(?:///)*(?://)*#*(?:/\\*)*\\**(?:\"\"\")*', '')) end d from c)
    select doc_id, i::int line_number, last_value(d ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and current row) docstring from d""")
def sticky_docstring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.contextual_lines(_commented(spark, sf_dir)).select("doc_id", "line_number", "docstring")


# every third line of a text becomes a heading
_HEADED = "h as (select doc_id, len(l) n, i, case when i % 3 = 1 then repeat('#', 1 + (i // 3) % 6) || ' ' || l[i] else l[i] end x from r)"


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.transform(text.lines(F.col("text")), lambda x, i: F.when((i + 1) % 3 == 1, F.concat(F.repeat(F.lit("#"), (1 + F.floor((i + 1) / 3) % 6).cast("int")), F.lit(" "), x)).otherwise(x))
    return _documents(spark, sf_dir).select("doc_id", F.array_join(marked, "\n").alias("text"))


_H = "'^(#{1,6})\\s+(.+?)\\s*#*\\s*$'"


@query(f"""with {_CONTEXT}, {_HEADED}, m as (select doc_id, n, i, length(regexp_extract(x, {_H}, 1)) lv, regexp_extract(x, {_H}, 2) title from h)
    select doc_id, i::int line, lv::int level, title, coalesce(lead(i) over (partition by doc_id order by i) - 1, n)::int end_line from m where lv > 0""")
def markdown_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.headings(_headed(spark, sf_dir))


@query(f"""with {_CONTEXT}, {_HEADED}, m as (select doc_id, n, i, x, length(regexp_extract(x, {_H}, 1)) lv, regexp_extract(x, {_H}, 2) title from h),
    k as (select *, coalesce(lead(i) over (partition by doc_id order by i) - 1, n) e from m where lv > 0),
    above as (select a.doc_id, a.i, string_agg(repeat('#', b.lv) || ' ' || b.title || chr(10), '' order by b.i) parents from k a join k b on a.doc_id = b.doc_id and b.i < a.i and b.lv < a.lv
      where not exists (select 1 from k c where c.doc_id = a.doc_id and c.i > b.i and c.i <= a.i and c.lv <= b.lv) group by a.doc_id, a.i),
    body as (select k.doc_id, k.i, k.e, k.lv, string_agg(m.x, chr(10) order by m.i) x, bool_or(m.i > k.i and trim(regexp_replace(m.x, '\\s+', ' ', 'g')) <> '') worded from k join m on m.doc_id = k.doc_id and m.i between k.i and k.e group by all),
    first as (select doc_id, min(i) i from k group by doc_id), root as (select m.doc_id, count(*) e, string_agg(x, chr(10) order by m.i) x, bool_or(trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '') worded from m join first f on f.doc_id = m.doc_id and m.i < f.i group by m.doc_id)
    select doc_id, i::int start_line, e::int end_line, 'h' || lv || '_section' element_type, sha256(coalesce(parents, '') || x) as content from body left join above using (doc_id, i) where worded
    union all select doc_id, 1, e::int, 'root_content', sha256(x) from root where worded""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    headed = _headed(spark, sf_dir).where(F.col("text").rlike(r"(?m)^#{1,6}\s+\S"))
    return chunks.markdown_sections(headed, limit=1 << 30).withColumn("content", F.sha2("content", 256))


@query("""with d as (select doc_id, string_split_regex(replace(text, chr(10), chr(10) || '---' || chr(10)), '(?m)^---\\s*$') p from documents), u as (select doc_id, unnest(generate_series(0, len(p) - 1)) document, p from d)
    select doc_id, document::int document, 'document' element_type, md5(p[document + 1]) content from u where trim(regexp_replace(p[document + 1], '\\s+', ' ', 'g')) <> ''""")
def yaml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n---\n")).alias("text"))
    return chunks.yaml_documents(docs).withColumn("content", F.md5("content"))


@query(f"""with l as (select doc_id, {LINES} l from documents), t as (select doc_id, l, list_filter(l, lambda x: trim(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) <> '' and not regexp_matches(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^(//|#|\\*)') and strlen(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) > 10 and regexp_matches(x, '[=(:]'))[1] a,
    list_filter(l, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '' and not regexp_matches(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^(//|#)'))[1] b from l), p as (select doc_id, len(l) n, coalesce(a, b, l[1]) x from t)
    select doc_id, case when n = 0 then '<empty content>' when strlen(x) > 120 then substr(x, 1, 117) || '...' else x end preview from p""")
def preview_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", code_intel.preview(F.col("text"), F.lit("block"), F.lit("text")).alias("preview"))


@query()
def code_chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = source_files(spark, sf_dir).drop("doc_id").withColumn("language", text.parser_language(F.col("file_path")))
    return code_chunks.chunk_files(files).withColumn("content", F.sha2("content", 256))


_PRIORITY = """case when contains(file_path, 'main') or contains(file_path, 'index') or contains(file_path, 'app') then 100 else 0 end + case when file_path like '%config' or contains(file_path, 'settings') then 50 else 0 end
    - case when contains(file_path, 'test') or contains(file_path, 'spec') then 50 else 0 end + n"""


@query(f"with {_PATHS}, f as (select file_path, n_chars % 10 n from paths) select file_path, n, ({_PRIORITY})::int priority from f")
def smart_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.smart_sort(_files(spark, sf_dir).select("file_path", (F.col("n_chars") % 10).alias("n")))


@query(f"with {_PATHS}, f as (select file_path, n_chars % 10 n from paths), s as (select file_path, n, ({_PRIORITY})::int priority, row_number() over (order by ({_PRIORITY}) desc, file_path)::int as position from f) select * from s where position between 11 and 20")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.page_of(_files(spark, sf_dir).select("file_path", (F.col("n_chars") % 10).alias("n")), 2, 10)
