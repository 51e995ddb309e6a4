"""Lines, globs, chunkers, scanners and code intelligence on small examples."""

import pytest
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.operators import chunks, code_chunks, code_intel, symbols


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("a\r\nb", ["a", "b"]), ("\n", [""])])
def test_lines(spark, text, want):
    assert one(spark, T.lines(F.col("t")), t=text) == want


def test_range_and_snippet(spark):
    text = "\n".join(f"l{i}" for i in range(1, 11))
    assert one(spark, T.range_of_lines(F.col("t"), 3, 4), t=text) == "l3\nl4"
    assert one(spark, T.snippet(F.col("t"), 5, 5, 1), t=text) == "...\n   4 : l4\n   5 | l5\n   6 : l6\n..."
    with pytest.raises(ValueError):
        T.range_of_lines(F.col("t"), 0, 1)


@pytest.mark.parametrize(("glob", "path", "want"), [("*.rs", "src/main.rs", True), ("src/*.rs", "src/a/b.rs", False), ("src/**/*.rs", "src/a/b.rs", True), ("**/*.rs", "main.rs", True), ("*.rs", ".git/x.rs", False), (".*", ".gitignore", True), ("test?.py", "tests/test1.py", True), ("[ab].c", "c.c", False)])
def test_globs(spark, glob, path, want):
    assert one(spark, T.glob_match(F.col("p"), glob), p=path) is want


@pytest.mark.parametrize(("kind", "language", "want"), [("function", None, True), ("type", "go", True), ("type", "rust", False), ("h2_section", None, True), ("h2_section_split_1", None, True), ("fallback_chunk_0", None, True), ("fallback_chunk", None, False), ("document", "yaml", False)])
def test_core_elements(spark, kind, language, want):
    row = spark.createDataFrame([(kind, language)], "k string, l string").select(T.core_element(F.col("k"), F.col("l")).alias("x")).first()
    assert row["x"] is want


def test_fallback_chunks(spark):
    files = spark.createDataFrame([("a", "\n".join(map(str, range(1001)))), ("b", ""), ("c", None)], "p string, text string")
    got = sorted(tuple(r)[:4] for r in chunks.fallback_chunks(files).collect())
    assert got == [("a", 1, 500, "fallback_chunk_0"), ("a", 501, 1000, "fallback_chunk_1"), ("a", 1001, 1001, "fallback_chunk_2"), ("b", 1, 1, "fallback_chunk"), ("c", 1, 1, "fallback_chunk")]


def test_markdown():
    text = "intro\n\n# Heading 1\nbody\n## Heading 1.1\nmore\n# Heading 2\nlast\n"
    got = [(a, b, k) for a, b, k, _ in chunks.markdown_chunks(text)]
    assert got == [(1, 2, "root_content"), (3, 4, "h1_section"), (5, 6, "h2_section"), (7, 8, "h1_section")]
    assert chunks.markdown_chunks(text)[2][3].startswith("# Heading 1\n## Heading 1.1")
    long = "# H\n" + "line of text\n" * 600
    parts = chunks.markdown_chunks(long)
    assert len(parts) > 2 and all(len(c.encode()) <= 3000 for *_, c in parts) and parts[-1][1] == 601
    assert [k for *_, k, _ in chunks.markdown_chunks("plain\ntext")] == ["root_plain_text"]
    assert chunks.markdown_chunks("  \n") == [] == chunks.markdown_chunks(None)
    assert [k for *_, k, _ in chunks.markdown_chunks("Title\n=====\nbody")] == ["h1_section"]


RUST = """/// Adds.
pub fn add(a: i32) -> i32 {
    let s = "}";
    a
}

struct P { x: i32 }

impl P {
    pub fn get(&self) -> i32 { self.x }
    fn set(&mut self) {
        self.x = 1; // }
    }
}

enum E { A, B }
trait T { fn f(&self); }
const N: u8 = 1;
"""


def test_rust_chunks():
    got = [(a, b, k) for a, b, k, _ in code_chunks.code_chunks(RUST, "rust")]
    assert got == [(1, 5, "function"), (7, 7, "struct"), (10, 10, "function"), (11, 13, "function"), (16, 16, "enum"), (17, 17, "trait"), (18, 18, "const")]
    assert code_chunks.code_chunks(RUST, "rust")[2][3].startswith("impl P {\n...\n")


def test_python_chunks():
    text = '@deco\ndef f(a):\n    """doc\ndef not_one():\n"""\n    def inner():\n        pass\n    return 1\n\n\nclass C:\n    x = 1\n\n    def m(self):\n        return 2\n'
    assert [(a, b, k) for a, b, k, _ in code_chunks.code_chunks(text, "python")] == [(1, 8, "function"), (11, 15, "class"), (14, 15, "function")]


def test_other_chunks():
    js = "function a() {\n  function b() { return 1; }\n}\nclass K {\n  go(x) {\n    return x;\n  }\n}\nconst f = () => 1;\n"
    assert [(a, k) for a, _, k, _ in code_chunks.code_chunks(js, "javascript")] == [(1, "function"), (4, "class"), (5, "method")]
    go = "package m\nfunc A() {\n}\nfunc (s *S) B() {\n}\ntype S struct {\n x int\n}\n"
    assert [(a, b, k) for a, b, k, _ in code_chunks.code_chunks(go, "go")] == [(2, 3, "function"), (4, 5, "method"), (6, 8, "type")]
    ruby = "module M\n  class C\n    def a\n      if x\n        1\n      end\n    end\n    def self.b\n    end\n  end\nend\n"
    assert [(a, b, k) for a, b, k, _ in code_chunks.code_chunks(ruby, "ruby")] == [(1, 11, "module"), (2, 10, "class"), (3, 7, "method")]
    ts = "interface I {\n  a: string;\n}\nexport enum E { A }\n"
    assert [k for *_, k, _ in code_chunks.code_chunks(ts, "typescript")] == ["interface", "enum"]
    assert [k for *_, k, _ in code_chunks.code_chunks("x = 1\n", "go")] == ["fallback_chunk_0"]
    assert code_chunks.code_chunks(" \n", "rust") == [] == code_chunks.code_chunks(None, "cpp")


def scan(spark, language, *lines):
    rows = symbols.contextual_lines(spark.createDataFrame([("\n".join(lines),)], "text string"))
    return [(r["name"], r["kind"], r["params"], r["line_number"]) for r in symbols.scan(rows, language).collect()]


@pytest.mark.parametrize(
    ("language", "line", "want"),
    [
        ("ruby", "def process_data(input, options = {})", ("process_data", "RubyInstance", "input, options = {}")),
        ("ruby", "  def self.build(x)", ("build", "RubyClass", "x")),
        ("ruby", "module Tools", ("Tools", "RubyModule", "")),
        ("ruby", "def start(name:, age: 3)", ("start", "RubyInstance", "name:, age: 3")),
        ("ruby", "  def note(*words, **more)", ("note", "RubyInstance", "*words, **more")),
        ("ruby", "def each_of(items, &block)", ("each_of", "RubyInstance", "items, &block")),
        ("ruby", "def empty?", ("empty", "RubyInstance", "")),
        ("ruby", "  def store!", ("store", "RubyInstance", "")),
        ("typescript", "interface User {", ("User", "TsInterface", "")),
        ("typescript", "function total(items: Item[]): number {", ("total", "TsFunction", "items: Item[]")),
        ("typescript", "async function load(url: string): Promise<D> {", ("load", "TsFunction", "url: string")),
        ("typescript", "const clean = (data: string) => {", ("clean", "TsArrow", "data: string")),
        ("typescript", "let ask = async () => {", ("ask", "TsArrow", "")),
        ("typescript", "class Store {", ("Store", "TsClass", "")),
        ("typescript", "export const f = (a) => a", ("f", "TsArrow", "a")),
        ("go", "func (s *Server) Run(port int) {", ("Run", "GoMethod", "s *Server")),
        ("vue", "  name: 'Widget',", ("Widget", "VueComponent", "")),
        ("vue", '  name: "List",', ("List", "VueComponent", "")),
        ("yaml", "port: 8080", ("port", "YamlValue", "8080")),
        ("markdown", "## Usage", ("Usage", "MarkdownHeader", "level 2")),
        ("python", "async def go(a, b):", ("async go", "PythonAsyncFunction", "a, b")),
        ("cpp", "namespace app {", ("app", "CppNamespace", "")),
        ("cpp", "static int twice(int x) {", ("twice", "CppStaticMethod", "int x")),
    ],
)
def test_scanners(spark, language, line, want):
    assert scan(spark, language, line)[0][:3] == want


def test_scanners_see_calls(spark):
    rows = symbols.contextual_lines(spark.createDataFrame([("def total\n  items.sum(&:price)\n  check(items)\nend",)], "text string"))
    got = symbols.scan(rows, "ruby").first()
    assert got["line_number"] == 1 and {"sum", "check"} <= set(got["calls"])


def test_rust_scanner_counts_indented_functions_twice(spark):
    assert [k for _, k, *_ in scan(spark, "rust", "impl A {", "    fn b(&self) {", "    }")] == ["RustImpl", "RustFn", "RustTraitMethod"]


def test_pages(spark):
    assert symbols.page_info(50, 2, 10) == {"total_files": 50, "files_per_page": 10, "current_page": 2, "total_pages": 5, "has_next": True, "has_previous": True}
    assert symbols.files_per_page(1000, 50, 100) == 5
    files = spark.createDataFrame([(p, 1) for p in ("main.rs", "regular.rs", "test_utils.rs", "app.rs", "config")], "file_path string, n int")
    assert [r["file_path"] for r in symbols.smart_sort(files).collect()] == ["app.rs", "main.rs", "config", "regular.rs", "test_utils.rs"]


def test_code_intelligence(spark):
    rust = "/// Authenticates a user.\npub fn authenticate_user(name: &str) -> bool {\n    let token = load(name);\n    check!(token)\n}"
    info = one(spark, code_intel.context_info(F.col("c"), F.lit("function"), F.lit("rust")), c=rust)
    assert info["signature"] == "pub fn authenticate_user(name: &str) -> bool"
    assert info["description"] == "Authenticates a user."
    assert info["related_identifiers"] == ["authenticate_user", "token"]
    assert info["outgoing_calls"] == ["authenticate_user", "check", "load"]
    assert one(spark, code_intel.context_info(F.col("c"), F.lit("x"), F.lit("zz")), c="1") is None
    preview = lambda c, e, lang: one(spark, code_intel.preview(F.col("c"), F.lit(e), F.lit(lang)), c=c)
    assert preview(rust, "function", "rust") == "pub fn authenticate_user(name: &str) -> bool {"
    assert preview("", "function", "rust") == "<empty content>"
    assert preview("x = '" + "é" * 100 + "'", "block", "zz").endswith("...")
    sig = one(spark, code_intel.signature(F.col("c"), F.lit("method"), F.lit("python")), c="def f(a: int) -> str:\n  pass")
    assert sig == "def f(a int) -> str"


def test_size_labels_equal_sql_over_a_gigabyte(spark, tmp_path):
    """The query's labels stop at MB, as its SQL does; the operator goes on to GB unless told."""
    import duckdb

    from tarn.functions.text import bytes_label
    from tarn.plans.catalogue import ORACLE_SQL, QUERIES

    rows = [(k * 50 + size, size) for k in (1, 9, 11, 300, 20_000, 24_000) for size in (1, 7, 50)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    db.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(db.execute(ORACLE_SQL["size_labels"]).fetchall())
    assert sorted(map(tuple, QUERIES["size_labels"](spark, str(tmp_path)).collect())) == want and any(x.endswith("MB") and float(x[:-3]) >= 1024 for _, x in want)
    label = lambda n, *a: spark.range(1).select(bytes_label(F.lit(n), *a).alias("x")).first()["x"]
    assert [label(3 * 1024**3), label(3 * 1024**3, "MB"), label(3 * 1024**3, "KB")] == ["3.0 GB", "3072.0 MB", "3145728.0 KB"]


def test_blocks_read_lines_once(spark):
    """Lines are cut once a text, not once a block."""
    docs = spark.createDataFrame([(1, "a\nb\r\nc\n"), (2, ""), (3, None)], "id long, text string")
    for made in (chunks.fallback_chunks(docs, size=2), chunks.simple_chunks(docs, size=2)):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    got = [(r["id"], r["start_line"], r["end_line"], r["element_type"], r["content"]) for r in chunks.fallback_chunks(docs, size=2).orderBy("id", "start_line").collect()]
    assert got == [(1, 1, 2, "fallback_chunk_0", "a\nb"), (1, 3, 3, "fallback_chunk_1", "c"), (2, 1, 1, "fallback_chunk", ""), (3, 1, 1, "fallback_chunk", "")]


def test_sections_are_made_of_few_texts_at_once(spark, monkeypatch):
    import pyarrow as pa

    docs, seen = spark.createDataFrame([(1, "# a\nb")], "id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: seen.append(f) or self, raising=True)
    chunks.markdown_sections(docs)
    n = 1000
    made = list(seen[0](iter([pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([f"# t{i}\nx\n" if i % 100 else None for i in range(n)])], ["id", "text"])])))
    assert max(b.num_rows for b in made) <= chunks.PART
    assert [(r["id"], r["start_line"], r["end_line"], r["element_type"], r["content"]) for b in made for r in b.to_pylist()] == [(i, 1, 2, "h1_section", f"# t{i}\nx") for i in range(n) if i % 100]
