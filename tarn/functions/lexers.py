"""What of a source text is code: lexers with a stack of modes, given as tables of rules for each language.

``code_of(text, language)`` is the text with everything else (comments, strings, what macros hold) as spaces, line by line
the same. A rule is (pattern, action, argument): in a mode the first of its rules that matches next applies.

- skip: what matches is no code
- push: what matches is no code, and neither is what follows until the pushed mode pops (holes in a template included)
- until: the same to the text that the argument makes of the match's groups, which may hold anything
- here: a here-document, which begins on the next line
- tree: what matches is code, what follows is none until its bracket closes
- pop: ends a mode
- test: like skip where the argument holds of what stands before
"""

from __future__ import annotations

import re
from functools import lru_cache

Rule = tuple[str, str, str | None]

_STRING = {"dq": [(r"\\.", "skip", None), (r'"|\n', "pop", None)], "sq": [(r"\\.", "skip", None), (r"'|\n", "pop", None)]}
_COMMENTS: list[Rule] = [(r"//[^\n]*", "skip", None), (r"/\*", "until", "*/")]
_BRACKETS: list[Rule] = [(r"[(\[{]", "push", "tree"), (r"[)\]}]", "pop", None)]

_RUST: list[Rule] = [
    (r"//[^\n]*", "skip", None), (r"/\*", "push", "nested"), (r'\b(?:br|cr|r)(#*)"', "until", '"{1}'), (r'(?<!\w)[bc]?"', "push", "long"), (r"(?<!\w)b?'(?:\\(?:u\{[^}']*\}|x..|.)|[^'\\\n])'", "skip", None),
]
_SCRIPT: list[Rule] = [*_COMMENTS, (r'"', "push", "dq"), (r"'", "push", "sq"), (r"`", "push", "template"), (r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*", "test", "operand")]
_RUBY: list[Rule] = [
    (r"(?m:^=begin\b)", "until", "\n=end"), (r"(?m:^__END__$)", "until", "\x00"), (r"#[^\n]*", "skip", None), (r"<<[~-]?(['\"`]?)([A-Z_a-z]\w*)\1", "here", "{2}"), (r'"', "push", "ruby_dq"), (r"'", "push", "long_sq"), (r"`", "push", "ruby_bq"),
    (r"%[qQwWiIrx]?([(\[{<])", "push", "percent{1}"), (r"%[qQwWiIrx]?([|!/^])(?=\S)", "test", "operand"), (r"/(?![ =])(?:\\.|[^/\\\n])+/[a-z]*", "test", "operand"),
]
_PYTHON: list[Rule] = [
    (r"#[^\n]*", "skip", None), (r'(?i:\b(?:[rbuft]|[rbft]{2}))?"""', "push", "triple_dq"), (r"(?i:\b(?:[rbuft]|[rbft]{2}))?'''", "push", "triple_sq"), (r'(?i:\b(?:[rbuft]|[rbft]{2}))?"', "push", "dq"), (r"(?i:\b(?:[rbuft]|[rbft]{2}))?'", "push", "sq"),
]

MODES: dict[str, dict[str, list[Rule]]] = {
    "rust": {
        "code": [*_RUST, (r"\b\w+!\s*(?:\w+\s*)?[(\[{]", "tree", None)], "tree": [*_RUST, *_BRACKETS],
        "nested": [(r"/\*", "push", "nested"), (r"\*/", "pop", None)], "long": [(r"\\.", "skip", None), (r'"', "pop", None)],
    },
    "javascript": {
        "code": _SCRIPT, **_STRING, "template": [(r"\\.", "skip", None), (r"\$\{", "push", "tree"), (r"`", "pop", None)], "tree": [*_SCRIPT, *_BRACKETS],
    },
    "go": {"code": [*_COMMENTS, (r'"', "push", "dq"), (r"`", "until", "`"), (r"'(?:\\[^\n]{1,9}?|[^'\\\n])'", "skip", None)], **_STRING},
    "cpp": {
        "code": [*_COMMENTS, (r"(?m:^[ \t]*#)(?:\\\n|[^\n])*", "skip", None), (r'\b(?:u8|[uUL])?R"([^\s()\\]{0,16})\(', "until", '){1}"'), (r'"', "push", "dq"), (r"(?<![0-9A-Fa-f])'(?:\\[^\n]{1,9}?|[^'\\\n])'", "skip", None)], **_STRING,
    },
    "python": {"code": _PYTHON, **_STRING, "triple_dq": [(r"\\.", "skip", None), (r'"""', "pop", None)], "triple_sq": [(r"\\.", "skip", None), (r"'''", "pop", None)]},
    "ruby": {
        "code": _RUBY, "tree": [*_RUBY, *_BRACKETS], "long_sq": [(r"\\.", "skip", None), (r"'", "pop", None)],
        "ruby_dq": [(r"\\.", "skip", None), (r"#\{", "push", "tree"), (r'"', "pop", None)], "ruby_bq": [(r"\\.", "skip", None), (r"#\{", "push", "tree"), (r"`", "pop", None)],
        **{f"percent{a}": [(r"\\.", "skip", None), (re.escape(a), "push", f"percent{a}"), (re.escape(b), "pop", None)] for a, b in ("()", "[]", "{}", "<>")},
    },
}
MODES["typescript"] = MODES["javascript"]

#: Words after which a slash or a per cent sign begins a literal; characters likewise.
_BEFORE_LITERAL = re.compile(r"(?:^|[(\[{,;=:!&|?+\-*%~^<>\n]|\b(?:return|typeof|case|in|of|do|else|when|if|unless|while|until|and|or|not|puts|yield|await|void|delete))\s*\Z")


@lru_cache(maxsize=64)
def _mode(language: str, name: str) -> tuple[re.Pattern, list[Rule]]:
    rules = MODES[language][name]
    return re.compile("|".join(f"(?P<r{i}>{_own_groups(p, i)})" for i, (p, _, _) in enumerate(rules)), re.S), rules


def _own_groups(pattern: str, i: int) -> str:
    """Numbered groups as named ones, so that rules can stand beside one another."""
    out, n, within, escaped = "", 0, False, False
    for k, c in enumerate(pattern):
        if c == "(" and not escaped and not within and pattern[k + 1] != "?":
            n += 1
            c = f"(?P<g{i}_{n}>"
        elif not escaped and c in "[]":
            within = c == "[" or (within and pattern[k - 1] == "[")
        escaped = c == "\\" and not escaped
        out += c
    return re.sub(r"\\([1-9])(?![0-9])", lambda m: f"(?P=g{i}_{m[1]})", out)


def code_of(text: str, language: str) -> str:
    """``text`` with all that is no code as spaces; a language without a table stays as it is."""
    if language not in MODES:
        return text
    out: list[str] = []
    stack, at = ["code"], 0
    here: list[str] = []  # here-documents that begin on the next line

    def emit(end: int, code: bool) -> None:
        nonlocal at
        if end > at:
            out.append(text[at:end] if code else re.sub(r"[^\n]", " ", text[at:end]))
            at = end

    while at < len(text):
        pattern, rules = _mode(language, stack[-1])
        m = pattern.search(text, at)
        code = stack[-1] == "code"
        stop = m.start() if m else len(text)
        if here and (line := text.find("\n", at, stop)) >= 0:  # bodies, one after another
            emit(line + 1, code)
            for name in here:
                end = re.compile(rf"^[ \t]*{re.escape(name)}[ \t]*$", re.M).search(text, at)
                emit(end.end() if end else len(text), False)
            here.clear()
            continue
        emit(stop, code)
        if m is None:
            break
        k = int(m.lastgroup[1:]) if m.lastgroup[0] == "r" else next(i for i in range(len(rules)) if m[f"r{i}"] is not None)
        _, action, argument = rules[k]
        group = lambda n, m=m, k=k: m[f"g{k}_{n}"]
        filled = re.sub(r"\{(\d)\}", lambda g: group(g[1]) or "", argument) if argument else None
        if action == "test":
            literal = _BEFORE_LITERAL.search(text, max(0, m.start() - 40), m.start()) is not None
            if literal and "%" == m[0][0]:  # one delimiter on both sides
                close = text.find(m[0][-1], m.end())
                emit(close + 1 if close >= 0 else len(text), False)
            else:
                emit(m.end() if literal else m.start() + 1, code and not literal)
        elif action == "skip":
            emit(m.end(), False)
        elif action == "push":
            emit(m.end(), False)
            stack.append(filled)
        elif action == "tree":
            emit(m.end(), code)
            stack.append("tree")
        elif action == "pop":
            if len(stack) > 1:
                bracket = stack.pop() == "tree"
                emit(m.end(), stack[-1] == "code" and bracket)
            else:
                emit(m.end(), code)
        elif action == "here":
            emit(m.end(), code)
            here.append(filled)
        else:  # until
            close = text.find(filled, m.end())
            emit(len(text) if close < 0 else close + len(filled), False)
    return "".join(out)
