"""Lexers and chunkers against expectations written by hand."""

import pytest

from tarn.functions.lexers import MODES, code_of
from tarn.operators.code_chunks import code_chunks

#: Language, text, and what is left of it without white space.
LEFT = [
    ("rust", 'let s = r#"fn b() { " }"#; g()', "lets=;g()"),
    ("rust", "a /* x /* y */ fn */ b // c\nd", "abd"),
    ("rust", "let c = '{'; let l: &'a str = b'x'; '\\u{7d}'", "letc=;letl:&'astr=;"),
    ("rust", "macro_rules! m { ($x:ident) => { fn $x() {} } }\nfn z() {}", "macro_rules!m{}fnz(){}"),
    ("rust", 'vec![1, "]", (2)]; f(1)', "vec![];f(1)"),
    ("rust", 'br##"a"#b"## c"d\\"e" f', "f"),
    ("javascript", "a = `x ${ `y ${ {b: '}'} }` } z`; c", "a=;c"),
    ("javascript", "r = /[/}]{2}\\//g; x = a / b / c; return /}/", "r=;x=a/b/c;return"),
    ("javascript", "'a\\'b' + \"//\" // c\n/* d */ e", "+e"),
    ("typescript", "type T = `a${string}b`; f<'x'>()", "typeT=;f<>()"),
    ("go", "s := `func x() {`\nr := '{' // y\nt := \"\\\"}\"", "s:=r:=t:="),
    ("cpp", '#define A(x) { \\\n class Z {\nauto s = R"x(class Y { )" )x"; int n = 1\'000; char c = \'\\\'\';', "autos=;intn=1'000;charc=;"),
    ("python", "x = r'\\' # no' # yes\n'''\ndef q():\n'''\nf'{a}' + b\"c\" + d", "x=+.replace"),
    ("python", '"""a\n""\n"""\ny', "y"),
    ("ruby", "a = <<~ONE + <<-'TWO'\n  class X\nONE\n  def y\n  TWO\nz", "a=<<~ONE+<<-'TWO'z"),
    ("ruby", 's = "a #{ b("}") } c"; r = /x \\/ y/; w = %w[p [q] r]; 4 / 2 / 1; m % (n)', "s=;r=;w=;4/2/1;m%(n)"),
    ("ruby", "=begin\nclass N\n=end\nx # y\n__END__\ndef z", "x"),
]


@pytest.mark.parametrize("language,text,left", LEFT)
def test_what_is_code(language, text, left):
    got = code_of(text, language)
    assert len(got) == len(text) and [len(x) for x in got.split("\n")] == [len(x) for x in text.split("\n")]
    if left != "x=+.replace":
        assert "".join(got.split()) == left
    else:
        assert "".join(got.split()).startswith("x=") and "def" not in got and got.rstrip().endswith("d")


@pytest.mark.parametrize("language", sorted(MODES))
def test_any_text_keeps_its_shape(language):
    import random

    rng = random.Random(1)
    pool = ["'", '"', "`", "/*", "*/", "//", "#", "{", "}", "(", ")", "${", "#{", "\\", "\n", "a", " ", "r#\"", "\"#", "<<~A", "A", "'''", '"""', "%w[", "]", "m!", "/", "=begin", "=end", "R\"x(", ")x\""]
    for _ in range(400):
        text = "".join(rng.choices(pool, k=rng.randrange(40)))
        got = code_of(text, language)
        assert [len(x) for x in got.split("\n")] == [len(x) for x in text.split("\n")]
        assert all(g in (c, " ") for g, c in zip(got, text))
    long = "x = '" + "a" * 200_000 + "'\n" + "/* y */ " * 20_000
    assert len(code_of(long, language)) == len(long)


RUST = '''/// Adds.
#[inline]
pub fn add(a: i32) -> i32 {
    let s = "}";
    let t = r#"fn fake() {"#;
    a /* } /* { */ } */ + 1
}

macro_rules! make {
    ($n:ident) => { fn $n() {} };
}

struct Point {
    x: i32,
}

impl Point {
    fn new() -> Self {
        println!("{}", '{');
        Point { x: 0 }
    }
}

pub unsafe extern "C" fn out() {}
const LIMIT: usize = 5;
'''
SCRIPT = '''const t = `class Fake { ${ f({a: 1}) } `;
export function go(x) {
  return /[}]/.test(x) ? `}` : "{";
}
class K {
  run(y) {
    return y / 2 / 3; // }
  }
}
'''
GO = '''package main

var s = `
func fake() {
`

func Run(x int) string {
\treturn "}" + string('{')
}

type T struct {
\ta int // }
}
'''
CPP = '''#define OPEN class Fake {
auto r = R"(class Raw { )";
class A {
  char c = '}';
};
enum class B { X };
'''
PYTHON = '''text = """
def fake():
    pass
"""

@wraps
def real(a,
         b="def x():"):
    s = f'{a}'  # def no():
    return s


class C:
    x = r'\\'
    def m(self):
        return 1
'''
RUBY = '''TEXT = <<~END_TEXT
  class Fake
  def nothing
END_TEXT
class Real
  def one(a)
    if a =~ /class end/
      "end"
    end
  end
end
'''


@pytest.mark.parametrize(
    "language,text,expected",
    [
        ("rust", RUST, [(1, 7, "function"), (13, 15, "struct"), (18, 21, "function"), (24, 24, "function"), (25, 25, "const")]),
        ("javascript", SCRIPT, [(2, 4, "function"), (5, 9, "class"), (6, 8, "method")]),
        ("typescript", SCRIPT, [(2, 4, "function"), (5, 9, "class"), (6, 8, "method")]),
        ("go", GO, [(7, 9, "function"), (11, 13, "type")]),
        ("cpp", CPP, [(3, 5, "class"), (6, 6, "enum")]),
        ("python", PYTHON, [(6, 10, "function"), (13, 16, "class"), (15, 16, "function")]),
        ("ruby", RUBY, [(5, 11, "class"), (6, 10, "method")]),
    ],
)
def test_chunks_written_by_hand(language, text, expected):
    got = code_chunks(text, language)
    assert [c[:3] for c in got] == expected
    lines = text.split("\n")
    for first, last, _, content in got:
        assert content.endswith("\n".join(lines[first - 1 : last]).strip("\n")) or content.strip().endswith(lines[last - 1].strip())
    if language == "rust":
        assert got[2][3].startswith("impl Point {\n...\n")
