"""Column expressions over file paths, lines and source text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions import fixed


def lines(text: Column) -> Column:
    """Lines as an array: a final line feed ends the last line, a carriage return before one is dropped, no text no lines."""
    whole = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(whole)


def numbered_lines(text: Column) -> Column:
    """Lines as an array of (line, text), counted from 1."""
    return F.transform(lines(text), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))


def range_of_lines(text: Column, start: int, end: int) -> Column:
    """Lines ``start`` to ``end``, joined."""
    if start < 1 or end < start:
        raise ValueError(f"no such range of lines: {start} to {end}")
    return F.array_join(F.slice(lines(text), start, end - start + 1), "\n")


def snippet(text: Column, start: int, end: int, context: int = 3) -> Column:
    """Numbered lines around a range; ``|`` marks the range, ``:`` its context, ``...`` what is left out."""
    low = max(1, start - context)
    kept = F.slice(numbered_lines(text), low, end + context - low + 1)
    shown = F.transform(kept, lambda x: F.format_string("%4d %s %s", x["line"], F.when(x["line"].between(start, end), "|").otherwise(":"), x["text"]))
    after = F.when(F.size(lines(text)) > end + context, F.array(F.lit("..."))).otherwise(F.array().cast("array<string>"))
    before = F.array(F.lit("...")) if low > 1 else F.array().cast("array<string>")
    return F.array_join(F.concat(before, shown, after), "\n")


def extension(path: Column) -> Column:
    """Extension without its dot, null if there is none."""
    found = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    return F.when(found != "", found)


def lookup(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    """A small table as a map literal."""
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.coalesce(key, F.lit(""))), F.lit(default))


def parser_language(path: Column) -> Column:
    return lookup(F.lower(extension(path)), fixed.PARSER_LANGUAGES, "fallback")


def embed_language(path: Column) -> Column:
    """The language that a file is embedded as, by its extension (or, without one, its name)."""
    return lookup(F.lower(F.coalesce(extension(path), F.regexp_extract(path, r"[^/]*$", 0))), fixed.EMBED_LANGUAGES, "unknown")


def core_of_language(kind: Column, language: Column) -> Column:
    """Whether an element is one of its language's own core elements; false for languages without a list."""
    return reduce(lambda rest, x: F.when(language == x[0], kind.isin(*x[1])).otherwise(rest), fixed.CORE_BY_LANGUAGE.items(), F.lit(False))


def file_type(path: Column) -> Column:
    return reduce(lambda rest, x: F.when(path.endswith(x[0]), x[1]).otherwise(rest), reversed(fixed.FILE_TYPES), F.lit("Other"))


def hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


def in_target(path: Column) -> Column:
    return path.rlike(r"(^|/)target/")


def ignored_by_map(path: Column) -> Column:
    return reduce(lambda a, b: a | b, (path.contains(x) for x in fixed.MAP_IGNORED))


def glob_pattern(glob: str, case_sensitive: bool = True) -> str:
    """A regular expression for a glob: ``*`` and ``?`` stay within a path's component, ``**`` crosses, a leading dot is nothing special."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out.append(f"[{'^' if body[0] in '!^' else ''}{re.escape(body[1:] if body[0] in '!^' else body).replace(chr(92) + '-', '-')}]")
            i = end + 1
            continue
        out.append({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)))
        i += 1
    return ("" if case_sensitive else "(?i)") + "^" + "".join(out) + "$"


def glob_match(path: Column, glob: str, case_sensitive: bool = True) -> Column:
    """Whether a path, or (for a glob without a slash) its last component, matches; nothing below ``.git`` does."""
    subject = path if "/" in glob else F.regexp_extract(path, r"[^/]*$", 0)
    return subject.rlike(glob_pattern(glob, case_sensitive)) & ~path.rlike(r"(^|/)\.git(/|$)")


def core_element(kind: Column, language: Column) -> Column:
    """Whether an element is indexed."""
    return (
        kind.isin(*fixed.CORE_ELEMENTS)
        | ((kind == "type") & F.coalesce(language == "go", F.lit(False)))
        | (kind.startswith("h") & kind.endswith("_section"))
        | kind.startswith("root_")
        | kind.contains("_section_split_")
        | kind.startswith("fallback_chunk_")
    )


def filename_term(term: Column, query: str) -> Column:
    """Whether a term of a query gets the boost of file names."""
    asked = query.lower()
    known = reduce(lambda a, b: a | b, (term.endswith(x) for x in fixed.FILENAME_EXTENSIONS))
    alike = term.contains("_") | term.contains("-") | term.contains(".") | ((F.octet_length(term) > 3) & term.rlike("[A-Z]"))
    in_query = F.lit(asked).contains(F.lower(term))
    context = F.lit(any(x in asked for x in fixed.FILENAME_CONTEXT))
    return (in_query & (known | alike)) | (context & (alike | term.isin(*fixed.FILENAME_NOUNS)))


def cut(line: Column, n: int = 120) -> Column:
    """A line of at most ``n`` bytes, else its first n-3 characters and three dots."""
    return F.when(F.octet_length(line) > n, F.concat(F.substring(line, 1, n - 3), F.lit("..."))).otherwise(line)


def bytes_label(n: Column, largest: str = "GB") -> Column:
    """B, KB, MB or GB with one decimal; nothing above ``largest``."""
    units = ["KB", "MB", "GB"]
    units = units[: units.index(largest) + 1]
    label = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for power, unit in enumerate(units[:-1], 1):
        label = label.when(n < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", n / 1024**power))
    return label.otherwise(F.format_string(f"%.1f {units[-1]}", n / 1024 ** len(units)))


def valid_ref(name: Column) -> Column:
    """Whether a name is a valid git reference."""
    return (F.length(name) > 0) & ~name.rlike(r"(^[/.-])|([/.]$)|(\.\.)|(//)|(@\{)|(\.lock$)|([\x00-\x20~^:?*\[\\\x7f])")
