"""What a chunk of code says of itself: signature, parent, description, identifiers, calls, a line to show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions import fixed
from tarn.functions.text import cut, lines

SAME = {"typescript": "javascript", "c++": "cpp", "c": "cpp"}


def _by_language(language: Column, choices: dict[str, Column], default: Column) -> Column:
    names = dict(choices) | {other: choices[base] for other, base in SAME.items() if base in choices}
    return reduce(lambda rest, x: F.when(language == x[0], x[1]).otherwise(rest), names.items(), default)


def _first(content: Column, patterns: tuple[str, ...], group: int = 0) -> Column:
    tries = [F.when(content.rlike(p), F.regexp_extract(content, p, group)) for p in patterns]
    return F.coalesce(*tries)


def signature(content: Column, element: Column, language: Column) -> Column:
    def of(name: str) -> Column:
        out = F.lit(None).cast("string")
        for elements, patterns in fixed.SIGNATURES[name]:
            found = F.trim(F.regexp_replace(_first(content, patterns), r"^\s+|\s+$", ""))
            if name == "python":
                found = F.regexp_replace(found, ":", "")
            out = F.when(element.isin(*elements), found).otherwise(out)
        return out

    return _by_language(language, {k: of(k) for k in fixed.SIGNATURES}, F.lit(None).cast("string"))


def parent_name(content: Column, language: Column) -> Column:
    return _by_language(language, {k: _first(content, p, 1) for k, p in fixed.PARENTS.items()}, F.lit(None).cast("string"))


def _long(texts: Column) -> Column:
    """The first text of more than 10 bytes."""
    return F.get(F.filter(texts, lambda x: x.isNotNull() & (F.octet_length(x) > 10)), 0)


def description(content: Column, language: Column) -> Column:
    every = F.transform(lines(content), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    strip = lambda x, p: F.trim(F.regexp_replace(x, p, ""))
    rust = _long(F.transform(every, lambda x: F.when(x.startswith("///"), strip(x, r"^(?:///)+"))))
    python = _long(F.transform(F.sequence(F.lit(0), F.size(every)), lambda i: F.when(F.get(every, i).rlike(r"^(?:\"\"\"|''')"), F.get(every, i + 1))))
    star = lambda x: F.when(x.startswith("* ") & ~x.startswith("* @"), strip(x, r"^(?:\* )+"))
    js = _long(F.transform(every, star))
    cpp = _long(F.transform(every, lambda x: F.when(x.startswith("///"), strip(x, r"^(?:///)+")).when(x.startswith("/**") & x.endswith("*/"), strip(x, r"^(?:/\*\*)+|(?:\*/)+$")).otherwise(star(x))))
    other = _long(F.transform(every, lambda x: F.when(x.startswith("//"), strip(x, r"^(?://)+"))))
    return _by_language(language, {"rust": rust, "python": python, "javascript": js, "cpp": cpp}, other)


def _all(content: Column, patterns: tuple[str, ...]) -> Column:
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in patterns))))


def _without(found: Column, words: tuple[str, ...]) -> Column:
    return F.array_except(found, F.array(*map(F.lit, words)))


def identifiers(content: Column, language: Column, most: int = 5) -> Column:
    """Names of more than two bytes that the content declares, sorted, at most ``most``."""

    def of(name: str) -> Column:
        words = fixed.IDENTIFIER_KEYWORDS.get(name, fixed.IDENTIFIER_KEYWORDS[""])
        return _without(F.filter(_all(content, fixed.IDENTIFIERS[name]), lambda x: F.octet_length(x) > 2), words)

    named = {k: of(k) for k in fixed.IDENTIFIERS if k}
    return F.slice(F.array_sort(_by_language(language, named, of(""))), 1, most)


def function_calls(content: Column, language: Column, most: int = 20) -> Column:
    """Names that the content calls, without keywords and generic names, sorted, at most ``most``."""

    def of(name: str) -> Column:
        found = F.filter(_all(content, fixed.CALLS[name]), lambda x: F.octet_length(x) > 1)
        return F.slice(F.array_sort(_without(_without(found, fixed.KEYWORDS[name]), fixed.NOT_CALLS)), 1, most)

    return _by_language(language, {k: of(k) for k in fixed.CALLS}, F.array().cast("array<string>"))


def preview(content: Column, element: Column, language: Column) -> Column:
    """The line that shows best what a chunk is, of at most 120 bytes."""
    every = lines(content)
    pick = lambda test: F.get(F.filter(every, lambda x: test(F.regexp_replace(x, r"^\s+|\s+$", ""))), 0)
    starts = lambda x, *p: reduce(lambda a, b: a | b, (x.startswith(w) for w in p))
    has = lambda x, *p: reduce(lambda a, b: a | b, (x.contains(w) for w in p))
    function = _by_language(
        language,
        {
            "rust": pick(lambda x: starts(x, "pub fn", "fn", "async fn")),
            "python": pick(lambda x: starts(x, "def ", "async def ")),
            "javascript": pick(lambda x: x.startswith("function ") | has(x, "=> {", "function(")),
        },
        pick(lambda x: x.contains("(") & has(x, "function", "def", "fn")),
    )
    declared = pick(lambda x: starts(x, "class ", "struct ", "pub struct "))
    telling = pick(lambda x: (x != "") & ~starts(x, "//", "#", "*") & (F.octet_length(x) > 10) & has(x, "=", "(", ":"))
    plain = pick(lambda x: (x != "") & ~starts(x, "//", "#"))
    chosen = F.coalesce(F.when(element.isin("function", "method"), function), F.when(element.isin("class", "struct"), declared), telling, plain, F.get(every, 0))
    return F.when(F.size(every) == 0, "<empty content>").otherwise(cut(chosen))


def context_info(content: Column, element: Column, language: Column) -> Column:
    """Struct of all of the above, null where there is nothing to say."""
    fields = F.struct(
        signature(content, element, language).alias("signature"),
        parent_name(content, language).alias("parent_name"),
        description(content, language).alias("description"),
        identifiers(content, language).alias("related_identifiers"),
        function_calls(content, language).alias("outgoing_calls"),
    )
    empty = fields["signature"].isNull() & fields["parent_name"].isNull() & fields["description"].isNull() & (F.size(fields["related_identifiers"]) == 0) & (F.size(fields["outgoing_calls"]) == 0)
    return F.when(~empty, fields)
