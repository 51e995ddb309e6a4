"""Symbols, maps and code intelligence over source files that whole documents are turned into.

Each line of a document becomes a line of code: two of its words fill one of the language's templates, in turn, so a file
has as many lines as its document and all constructs of its language. Document ``doc_id`` is of language ``doc_id % 10``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import fixed
from tarn.functions.frames import spread
from tarn.functions.text import lines
from tarn.operators import code_intel, symbols
from tarn.plans.register import query
from tarn.session import table

TEMPLATES = {
    "rust": ["/// Does {a} with care", "pub fn {a}(x: u8) -> u8 {", "    let {b} = inner::go(x);", "    {b}.step(1);", "}", "impl {a} {", "    fn {b}(&self) { println!(1) }", "}", "pub trait T{a} {", "    fn each(&self);", "}"],
    "python": ["class C{a}:", "    # counts {b}", "    @staticmethod", "    def make_{b}({a}, size=1):", "        total = len({a}) + self.{b}(size)", "        return build_{a}(total)", "async def run_{a}(x):", "    return await fetch_{b}(x)", "def {a}_{b}(items):", "    return [f(i) for i in items]", "    @classmethod", "    def of_{a}(cls):"],
    "javascript": ["// {a} comes first", "function {a}(x, {b}) {", "  return load{b}(x).then({a});", "}", "const f{a} = async (x) => x;", "class K{b} {", "  go(x) {", "    x: function() {},", "}", "export default {a};"],
    "typescript": ["/* {b} */", "export async function {a}(x: string): void {", "export class C{a} {", "  private m{b}(x: number): string {", "    return this.{b}.go(x);", "interface I{b} {", "type T{a} = string;", "const g{b} = (x) => x;", "}"],
    "go": ["// {a} runs", "func (s *S{a}) Run{b}(port int) {", "func {a}(x int) error {", "    fmt.Println({b}(x))", "}", "type I{a} interface {", "    Get{b}(x int)", "}"],
    "ruby": ["# {a} at work", "module M{a}", "  def self.build_{b}(x)", "    {a}.run(x).each", "  end", "  def {a}(x, {b} = 1)", "    x.go", "  end", "end"],
    "vue": ["<script>", "  name: '{a}',", "  props: {", "    size{b}: {", "  methods: {", "    go{a}(x) {", "      this.{b}(x)", "  computed: {", "    sum{b}() {", "// {b}"],
    "yaml": ["# {a}", "{a}:", "  template: t-{b}", "{b}: 8080", "list{a}: x {b}"],
    "markdown": ["# {a} and {b}", "text of {a}", "## Use {b}", "### {a}", "- {b}"],
    "cpp": ["// {a}", "namespace n{a} {", "class C{b} {", "struct S{a} : B {", "static int twice{b}(int x) {", "  return {a}(x);", "virtual void go{a}(int x);", "int f{b}(int x) const {", "if (x) {", "}"],
}
LANGUAGES = tuple(TEMPLATES)
EXTENSION = {"rust": "rs", "python": "py", "javascript": "js", "typescript": "ts", "go": "go", "ruby": "rb", "vue": "vue", "yaml": "yml", "markdown": "md", "cpp": "cc"}

_WORDS = "([a-zA-Z]+)[^a-zA-Z]+([a-zA-Z]+)"


def _filled(template: str, a: Column, b: Column) -> Column:
    parts: list[Column] = []
    for piece in template.replace("{a}", "\x00a\x00").replace("{b}", "\x00b\x00").split("\x00"):
        parts.append({"a": a, "b": b}.get(piece, F.lit(piece)))
    return F.concat(*parts)


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, file_path, language, text."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))

    def code(templates: list[str]):
        def one(line: Column, i: Column) -> Column:
            word = lambda g, other: F.coalesce(F.nullif(F.lower(F.regexp_extract(line, _WORDS, g)), F.lit("")), F.lit(other))
            a, b = word(1, "alpha"), word(2, "beta")
            out = _filled(templates[0], a, b)
            for k, t in enumerate(templates[1:], 1):
                out = F.when(i % len(templates) == k, _filled(t, a, b)).otherwise(out)
            return out

        return F.array_join(F.transform(lines(F.col("text")), one), "\n")

    kind = F.col("doc_id") % len(LANGUAGES)
    text, name = F.lit(""), F.lit("")
    for k, language in enumerate(LANGUAGES):
        text = F.when(kind == k, code(TEMPLATES[language])).otherwise(text)
        name = F.when(kind == k, EXTENSION[language]).otherwise(name)
    path = F.concat("source", F.lit("/f"), "doc_id", F.lit("."), name)
    return docs.select("doc_id", path.alias("file_path"), F.element_at(F.array(*map(F.lit, LANGUAGES)), (kind + 1).cast("int")).alias("language"), text.alias("text"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled_sql(template: str) -> str:
    return "(" + _q(template).replace("{a}", "' || a || '").replace("{b}", "' || b || '") + ")"


def _case(templates: list[str]) -> str:
    return f"case i0 % {len(templates)} " + " ".join(f"when {k} then {_filled_sql(t)}" for k, t in enumerate(templates)) + " end"


_LINES = "case when coalesce(text, '') = '' then []::varchar[] else string_split_regex(regexp_replace(text, '\\r?\\n$', ''), '\\r?\\n') end"
FILES_SQL = f"""raw as (select doc_id, source, {_LINES} l from documents), each as (select doc_id, source, unnest(l) x, unnest(generate_series(0, len(l) - 1)) i0 from raw),
    worded as (select *, coalesce(nullif(lower(regexp_extract(x, '{_WORDS}', 1)), ''), 'alpha') a, coalesce(nullif(lower(regexp_extract(x, '{_WORDS}', 2)), ''), 'beta') b from each),
    code as (select doc_id, i0 + 1 i, case doc_id % 10 {" ".join(f"when {k} then {_case(TEMPLATES[language])}" for k, language in enumerate(LANGUAGES))} end line,
        source || '/f' || doc_id || '.' || case doc_id % 10 {" ".join(f"when {k} then '{EXTENSION[language]}'" for k, language in enumerate(LANGUAGES))} end file_path,
        case doc_id % 10 {" ".join(f"when {k} then '{language}'" for k, language in enumerate(LANGUAGES))} end "language" from worded),
    cx as (select *, array_to_string(array_agg(line) over (partition by doc_id order by i rows between 2 preceding and 2 following), chr(10)) context,
        last_value(case when regexp_matches(line, '^\\s*(?://|#|/\\*|\\*|\"\"\")') then trim(regexp_replace(line, '^(?:///)*(?://)*#*(?:/\\*)*\\**(?:\"\"\")*', '')) end ignore nulls) over (partition by doc_id order by i) docstring from code)"""


def _found_sql(language: str) -> str:
    """All symbols of one language's lines."""
    mode, patterns = fixed.SYMBOLS[language]
    method = "\\.([a-zA-Z_][a-zA-Z0-9_]*)\\b" if language == "ruby" else "\\.([a-zA-Z_][a-zA-Z0-9_]*)\\("
    calls = f"array_to_string(list_sort(list_distinct(regexp_extract_all(context, '\\b([a-zA-Z_][a-zA-Z0-9_]*)\\(', 1) || regexp_extract_all(context, '{method}', 1)))[1:10], ',')"
    params = "trim(regexp_extract(line, '^[^(]*\\(([^)]*)\\)', 1))"
    more = {
        "GoInterfaceMethod": "contains(context, 'interface')", "VueComputed": "contains(context, 'computed')", "VueMethod": "not contains(context, 'computed') and contains(context, 'methods')",
        "VueProp": "not contains(context, 'computed') and not contains(context, 'methods') and contains(context, 'props')",
    }
    earlier, out = [], []
    for kind, pattern in patterns:
        name = f"regexp_extract(line, {_q(pattern)}, 1)"
        good = f"regexp_matches(line, {_q(pattern)})"
        if kind in more:
            good += f" and {more[kind]}"
        if kind.startswith("Cpp"):
            good += " and not regexp_matches(line, '^\\s*(?://|/\\*)')"
        if kind == "CppFunction":
            good += f" and {name} not in ('if', 'while', 'for', 'switch', 'catch')"
        shown = f"'{kind}'"
        if kind == "PythonFunction":
            shown = "case when not (starts_with(line, '    ') or starts_with(line, chr(9))) then 'PythonFunction' when contains(context, '@staticmethod') then 'PythonStaticMethod' when contains(context, '@classmethod') then 'PythonClassMethod' else 'PythonMethod' end"
        if kind == "CppFunction":
            shown = "case when contains(line, 'static') then 'CppStaticMethod' when contains(line, 'virtual') then 'CppVirtualMethod' else 'CppFunction' end"
        if kind == "PythonAsyncFunction":
            name = f"'async ' || {name}"
        values = params
        if language == "markdown":
            name, values = f"trim({name})", "'level ' || length(regexp_extract(line, '^(#{1,6})\\s', 1))"
        elif kind == "YamlValue":
            values = "trim(regexp_extract(line, '^[a-zA-Z0-9_-]+:\\s*(.+)$', 1))"
        elif kind in fixed.WITHOUT_PARAMS:
            values = "''"
        first = "".join(f" and not ({e})" for e in earlier) if mode == "first" else ""
        out.append(f"select doc_id, file_path, \"language\", i::int line_number, {name} as name, {shown} kind, {values} params, {chr(39) * 2 if kind in fixed.WITHOUT_CALLS else calls} calls, docstring, context from cx where \"language\" = '{language}' and {good}{first}")
        earlier.append(good)
    return " union all ".join(out)


SYMBOLS_SQL = "syms as (" + " union all ".join(map(_found_sql, LANGUAGES)) + ")"


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.repo_map(source_files(spark, sf_dir).drop("language"))


def _scan(spark: SparkSession, sf_dir: str, language: str) -> DataFrame:
    rows = symbols.contextual_lines(source_files(spark, sf_dir).where(F.col("language") == language).select("doc_id", "text"))
    return symbols.scan(rows, language).select("doc_id", "line_number", "name", "kind", "params", F.array_join("calls", ",").alias("calls"))


def _scanner(language: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _scan(spark, sf_dir, language)

    run.__name__ = f"symbol_scan_{language}"
    query(f"with {FILES_SQL}, s as ({_found_sql(language)}) select doc_id, line_number, name, kind, params, calls from s")(run)


for _language in LANGUAGES:
    _scanner(_language)


@query(f"with {FILES_SQL}, {SYMBOLS_SQL} select file_path, \"language\", line_number, name, kind, params, docstring, calls from syms")
def repo_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("file_path", "language", "line_number", "name", "kind", "params", "docstring", F.array_join("calls", ",").alias("calls"))


def _by(column: str, names: dict[str, str]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {_q(v)}" for k, v in names.items()) + " end"


_TYPES = "case " + " ".join(f"when ends_with(file_path, '{e}') then '{n}'" for e, n in fixed.FILE_TYPES) + " else 'Other' end"


@query(f"""with {FILES_SQL}, {SYMBOLS_SQL}, f as (select file_path, count(*) m from syms group by file_path) select 'total' what, 'files' as name, count(*) n from f
    union all select 'total', 'methods', coalesce(sum(m), 0)::bigint from f union all select 'file_type', {_TYPES}, count(*) from f group by 2 union all select 'method_type', {_by('kind', fixed.KIND_NAMES)}, count(*) from syms group by 2""")
def repo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.summary(_mapped(spark, sf_dir))


@query(f"with {FILES_SQL}, {SYMBOLS_SQL} select array_to_string(list_sort(list(distinct \"language\")), ',') languages from syms")
def repo_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.languages(_mapped(spark, sf_dir)).select(F.array_join("languages", ",").alias("languages"))


_ENTRY = f"""'  ' || {_by('kind', fixed.KIND_ICONS)} || ' ' || name || case when params = '' then '' else '(' || params || ')' end || chr(10)
    || case when docstring is not null then '    📝 ' || docstring || chr(10) else '' end || case when calls <> '' then '    📞 Calls: ' || replace(calls, ',', ', ') || chr(10) else '' end"""


@query(f"with {FILES_SQL}, {SYMBOLS_SQL}, e as (select file_path, line_number, kind, {_ENTRY} entry from syms) select file_path, sha256(chr(10) || '📁 ' || file_path || chr(10) || string_agg(entry, '' order by line_number, kind, entry)) as text from e group by file_path")
def repo_map_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.rendered(_mapped(spark, sf_dir)).withColumn("text", F.sha2("text", 256))


@query(f"with {FILES_SQL}, {SYMBOLS_SQL} select 3 + 2 * count(distinct file_path) + sum(1 + (docstring is not null)::int + (calls <> '')::int)::bigint as lines from syms")
def repo_line_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.line_estimate(_mapped(spark, sf_dir))


@query(f"""with {FILES_SQL}, {SYMBOLS_SQL}, e as (select distinct name caller, unnest(string_split(calls, ',')) callee from syms where calls <> '') select distinct caller, callee, kind callee_kind from e join syms on callee = name""")
def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.call_graph(_mapped(spark, sf_dir))


_LIST = lambda words: "[" + ", ".join(map(_q, words)) + "]"
_TEXTS = "whole as (select doc_id, \"language\", string_agg(line, chr(10) order by i) c from code group by all)"
_EVERY = lambda patterns: " || ".join(f"regexp_extract_all(c, {_q(p)}, 1)" for p in patterns)


def _languages_with(known: dict) -> list[tuple[str, str]]:
    """Languages and the one whose tables they take."""
    return [(x, code_intel.SAME.get(x, x)) for x in LANGUAGES if code_intel.SAME.get(x, x) in known]


_CALLS_SQL = " ".join(f"when '{y}' then list_filter(list_distinct({_EVERY(fixed.CALLS[x])}), lambda x: strlen(x) > 1 and not list_contains({_LIST(fixed.KEYWORDS[x])}, x) and not list_contains({_LIST(fixed.NOT_CALLS)}, x))" for y, x in _languages_with(fixed.CALLS))


@query(f"with {FILES_SQL}, {_TEXTS}, f as (select doc_id, case \"language\" {_CALLS_SQL} else []::varchar[] end f from whole) select doc_id, array_to_string(list_sort(f)[1:20], ',') calls from f")
def extract_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = source_files(spark, sf_dir).where("text <> ''")
    return files.select("doc_id", F.array_join(code_intel.function_calls(F.col("text"), F.col("language")), ",").alias("calls"))


_IDS_SQL = lambda x: f"list_filter(list_distinct({_EVERY(fixed.IDENTIFIERS[x])}), lambda x: strlen(x) > 2 and not list_contains({_LIST(fixed.IDENTIFIER_KEYWORDS.get(x, fixed.IDENTIFIER_KEYWORDS['']))}, x))"


@query(f"""with {FILES_SQL}, {_TEXTS}, f as (select doc_id, case "language" {" ".join(f"when '{y}' then {_IDS_SQL(x)}" for y, x in _languages_with(fixed.IDENTIFIERS))} else {_IDS_SQL('')} end f from whole) select doc_id, array_to_string(list_sort(f)[1:5], ',') identifiers from f""")
def extract_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = source_files(spark, sf_dir).where("text <> ''")
    return files.select("doc_id", F.array_join(code_intel.identifiers(F.col("text"), F.col("language")), ",").alias("identifiers"))


@query(f"""with {FILES_SQL}, {_TEXTS} select doc_id, trim(regexp_extract(c, '(?m)^[\\s]*(?:pub\\s+)?(?:async\\s+)?fn\\s+\\w+[^{{]*')) signature, regexp_extract(c, 'impl\\s+(?:\\w+\\s+for\\s+)?(\\w+)', 1) parent_name, trim(regexp_extract(c, '///([^\\n]*)', 1)) description
    from whole where "language" = 'rust' and regexp_matches(c, 'fn ') and regexp_matches(c, 'impl ')""")
def code_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = code_intel.context_info(F.col("text"), F.lit("function"), F.lit("rust"))
    files = source_files(spark, sf_dir).where("language = 'rust' and contains(text, 'fn ') and contains(text, 'impl ')")
    return files.select("doc_id", info.alias("i")).select("doc_id", "i.signature", "i.parent_name", "i.description")


def _signature_sql(language: str, base: str) -> str:
    patterns = next(p for elements, p in fixed.SIGNATURES[base] if "function" in elements)
    found = "case " + " ".join(f"when regexp_matches(c, {_q(p)}) then regexp_extract(c, {_q(p)})" for p in patterns) + " end"
    found = f"trim(regexp_replace({found}, '^\\s+|\\s+$', '', 'g'))"
    return f"when '{language}' then " + (f"replace({found}, ':', '')" if base == "python" else found)


def _parent_sql(language: str, base: str) -> str:
    return f"when '{language}' then case " + " ".join(f"when regexp_matches(c, {_q(p)}) then regexp_extract(c, {_q(p)}, 1)" for p in fixed.PARENTS[base]) + " end"


@query(f"""with {FILES_SQL}, {_TEXTS} select doc_id, "language", case "language" {" ".join(_signature_sql(*x) for x in _languages_with(fixed.SIGNATURES))} end signature, case "language" {" ".join(_parent_sql(*x) for x in _languages_with(fixed.PARENTS))} end parent from whole where c <> ''""")
def code_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first signature and parent in each file, in all languages that have any."""
    files = source_files(spark, sf_dir).where("text <> ''")
    return files.select("doc_id", "language", code_intel.signature(F.col("text"), F.lit("function"), F.col("language")).alias("signature"), code_intel.parent_name(F.col("text"), F.col("language")).alias("parent"))
