"""Chunks of source code by scanning braces, indentation and block words.

No grammar is used: what stands in strings, comments and macros is blanked first by the language's lexer, then declarations
at the right depth are found by their first line and followed to where their block ends. Files run through ``mapInPandas`` row by row; nothing
is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tarn.functions import fixed
from tarn.functions.lexers import code_of
from tarn.operators.chunks import _split_lines, markdown_chunks

Chunk = tuple[int, int, str, str]
#: Fixed value: lines of the blocks of a file in which nothing was found.
REST_LINES = 200

DECLARATIONS = {
    "rust": (("function", r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+)?fn\s+\w+"), ("struct", r"\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+\w+"), ("enum", r"\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+\w+"), ("trait", r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+\w+"), ("impl", r"\s*(?:unsafe\s+)?impl\b"), ("module", r"\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+\w+"), ("const", r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+\w+\s*:")),
    "javascript": (("function", r"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b"), ("class", r"\s*(?:export\s+)?(?:default\s+)?class\s+\w+"), ("method", r"\s+(?:static\s+)?(?:async\s+)?(?:get\s+|set\s+)?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)[\w$#]+\s*\([^)]*\)\s*\{")),
    "typescript": (("function", r"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b"), ("class", r"\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+\w+"), ("interface", r"\s*(?:export\s+)?interface\s+\w+"), ("enum", r"\s*(?:export\s+)?(?:const\s+)?enum\s+\w+"), ("method", r"\s+(?:public\s+|private\s+|protected\s+)?(?:static\s+)?(?:async\s+)?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)[\w$#]+\s*\([^)]*\)\s*(?::\s*[^{=;]+)?\{")),
    "go": (("method", r"func\s+\([^)]*\)\s*\w+"), ("function", r"func\s+\w+"), ("type", r"type\s+\w+"), ("const", r"const\b")),
    "cpp": (("class", r"\s*(?:template\s*<[^>]*>\s*)?class\s+\w+[^;]*$"), ("struct", r"\s*(?:template\s*<[^>]*>\s*)?struct\s+\w+[^;]*$"), ("enum", r"\s*enum\s+(?:class\s+)?\w+")),
}


def block_end(lines: list[str], start: int) -> int:
    """Last line of the braces that open at or after a line, or of a statement that ends before any opens."""
    depth, opened = 0, False
    for i in range(start, len(lines)):
        for c in lines[i]:
            if c in "{(":
                depth, opened = depth + 1, opened or c == "{"
            elif c in "})":
                depth -= 1
            elif c == ";" and not depth and not opened:
                return i
        if opened and depth <= 0:
            return i
        if not opened and not depth and i > start and not lines[i].strip():
            return i - 1
    return len(lines) - 1


def brace_chunks(text: str, language: str) -> list[Chunk]:
    every, plain = _split_lines(text), _split_lines(code_of(text, language))
    plain += [""] * (len(every) - len(plain))
    depth = [0]
    for line in plain:
        depth.append(depth[-1] + line.count("{") - line.count("}"))
    found: list[Chunk] = []
    covered = -1
    inside: list[tuple[int, str, str]] = []  # end and signature of impl, end of functions
    for i, line in enumerate(plain):
        inside = [x for x in inside if x[0] >= i]
        if language == "rust" and i <= covered:
            continue
        for kind, pattern in DECLARATIONS[language]:
            if not re.match(pattern, line) or (language in ("go", "cpp") and depth[i] and language == "go"):
                continue
            if language == "rust" and depth[i] - len(inside) > 0:
                continue
            if language == "javascript" and kind == "function" and any(x[1] == "function" for x in inside):
                continue
            end = block_end(plain, i)
            if language == "rust" and kind == "impl":
                inside.append((end, "impl", every[i].strip()))
                break
            start = i
            if language == "rust" and kind in ("struct", "enum", "trait", "function"):
                while start > 0 and re.match(r"\s*(///|#\[)", every[start - 1]):
                    start -= 1
            content = "\n".join(every[start : end + 1])
            owner = [x[2] for x in inside if x[1] == "impl"]
            if owner:
                content = f"{owner[-1]}\n...\n{content}"
            found.append((start + 1, end + 1, kind, content))
            if language == "rust":
                covered = end
            else:
                inside.append((end, kind, ""))
            break
    return found


def python_chunks(text: str) -> list[Chunk]:
    every, plain = _split_lines(text), _split_lines(code_of(text, "python"))
    plain += [""] * (len(every) - len(plain))
    indent = lambda s: len(s) - len(s.lstrip())
    found: list[Chunk] = []
    classes: list[tuple[int, int]] = []  # indentation and last line
    hidden: list[int] = []
    for i, line in enumerate(plain):
        m = re.match(r"(\s*)(?:async\s+)?(def|class)\s+\w+", line)
        if not m:
            continue
        level = len(m[1])
        classes = [c for c in classes if c[1] >= i]
        hidden = [h for h in hidden if h >= i]
        if hidden or (level and not classes):
            continue
        end = i
        for j in range(i + 1, len(plain)):
            if every[j].strip() and indent(every[j]) <= level and (plain[j].strip() or every[j].lstrip().startswith("#")) and not every[j].lstrip().startswith(")"):
                break
            if every[j].strip():
                end = j
        start = i
        while start > 0 and re.match(r"\s*@", plain[start - 1]) and indent(plain[start - 1]) == level:
            start -= 1
        found.append((start + 1, end + 1, "function" if m[2] == "def" else "class", "\n".join(every[start : end + 1])))
        if m[2] == "class":
            classes.append((level, end))
        else:
            hidden.append(end)
    return found


def ruby_chunks(text: str) -> list[Chunk]:
    every, plain = _split_lines(text), _split_lines(code_of(text, "ruby"))
    plain += [""] * (len(every) - len(plain))
    opens = re.compile(r"\s*(?:class|module|def|if|unless|while|until|case|begin|for)\b|.*\bdo\b(?:\s*\|[^|]*\|)?\s*$")
    found, stack = [], []
    for i, line in enumerate(plain):
        if re.match(r"\s*end\b", line) and stack:
            kind, start = stack.pop()
            if kind:
                found.append((start + 1, i + 1, kind, "\n".join(every[start : i + 1])))
        elif opens.match(line) and not re.search(r"\bend\s*$", line):
            m = re.match(r"\s*(class|module|def)\s+(self\.)?", line)
            stack.append(("method" if m and m[1] == "def" and not m[2] else m[1] if m and m[1] != "def" else "", i))
    return sorted(found)


def rest_chunks(text: str) -> list[Chunk]:
    every = _split_lines(text)
    blocks = [(s + 1, min(s + REST_LINES, len(every)), "\n".join(every[s : s + REST_LINES])) for s in range(0, len(every), REST_LINES)]
    return [(a, b, f"fallback_chunk_{k}", c) for k, (a, b, c) in enumerate(blocks) if c.strip()]


def code_chunks(text: str | None, language: str) -> list[Chunk]:
    """(start, end, type, content) of a text of a known language."""
    text = text or ""
    if language == "markdown":
        return markdown_chunks(text)
    if language == "python":
        found = python_chunks(text)
    elif language == "ruby":
        found = ruby_chunks(text)
    elif language in DECLARATIONS:
        found = brace_chunks(text, language)
    else:
        found = []
    core = {"type"} if language == "go" else set()
    found = [c for c in found if c[2] in fixed.CORE_ELEMENTS or c[2] in core]
    return found or (rest_chunks(text) if text.strip() else [])


def chunk_files(files: DataFrame, text: str = "text", language: str = "language", parsers: dict | None = None) -> DataFrame:
    """``files`` without the text, one row per chunk. ``parsers`` adds or replaces languages: text -> chunks."""
    rest = [c for c in files.columns if c != text]
    own = dict(parsers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                name = r[language]
                chunks = own[name](r[text] or "") if name in own else code_chunks(r[text], name)
                rows += [(*(r[c] for c in rest), *c) for c in chunks]
            yield pd.DataFrame(rows, columns=[*rest, "start_line", "end_line", "element_type", "content"])

    kinds = {f.name: f.dataType.simpleString() for f in files.schema}
    return files.mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in rest), "start_line int, end_line int, element_type string, content string"]))
