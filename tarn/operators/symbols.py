"""Repository maps: symbols of source lines, summaries, order and pages of files.

A file's lines, their context and the comment seen last are arrays within the file's row: a scan of any number of files
shuffles nothing.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.functions import fixed
from tarn.functions.frames import settled
from tarn.functions.text import file_type, ignored_by_map, lines, lookup, parser_language

COMMENT = r"^\s*(?://|#|/\*|\*|\"\"\")"
MARKERS = r"^(?:///)*(?://)*#*(?:/\*)*\**(?:\"\"\")*"


def contextual_lines(files: DataFrame, text: str = "text", around: int = 2) -> DataFrame:
    """One row per line: line_number, line, context (the lines around it), docstring (the comment seen last, if any)."""
    rest = [c for c in files.columns if c != text]
    every = settled(files.select(*rest, F.col(text).alias("_t")), {"_l": lines(F.col("_t"))}).drop("_t")
    doc = F.transform("_l", lambda x: F.when(x.rlike(COMMENT), F.trim(F.regexp_replace(x, MARKERS, ""))))
    every = settled(every, {"_d": doc, "_n": F.size("_l")})
    marks = F.filter(F.transform("_d", lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())
    every = settled(every, {"_p": marks})
    # the comment seen last: each comment as often as there are lines up to the next one
    runs = F.flatten(F.transform("_p", lambda p, k: F.array_repeat(F.get("_d", p), F.coalesce(F.get("_p", k + 1), F.col("_n")) - p)))
    carried = F.concat(F.array_repeat(F.lit(None).cast("string"), F.coalesce(F.get("_p", F.lit(0)), F.col("_n"))), runs)
    rows = settled(every, {"_c": carried}).select(*rest, "_l", "_c", F.posexplode("_l").alias("_i", "line"))
    start = F.greatest(F.col("_i") - around, F.lit(0))
    context = F.array_join(F.slice("_l", start + 1, F.col("_i") + around + 1 - start), "\n")
    return rows.select(*rest, (F.col("_i") + 1).alias("line_number"), "line", context.alias("context"), F.get("_c", F.col("_i")).alias("docstring"))


def params(line: Column) -> Column:
    """The text in the first parentheses."""
    return F.trim(F.regexp_extract(line, r"^[^(]*\(([^)]*)\)", 1))


def calls(context: Column, language: str, most: int = 10) -> Column:
    """Names that are called in a context, sorted, at most ``most``."""
    method = r"\.([a-zA-Z_][a-zA-Z0-9_]*)\b" if language == "ruby" else r"\.([a-zA-Z_][a-zA-Z0-9_]*)\("
    both = F.concat(F.regexp_extract_all(context, F.lit(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\("), F.lit(1)), F.regexp_extract_all(context, F.lit(method), F.lit(1)))
    return F.slice(F.array_sort(F.array_distinct(both)), 1, most)


def _condition(kind: str, context: Column, line: Column) -> Column:
    if kind == "GoInterfaceMethod":
        return context.contains("interface")
    if kind == "VueComputed":
        return context.contains("computed")
    if kind == "VueMethod":
        return ~context.contains("computed") & context.contains("methods")
    if kind == "VueProp":
        return ~context.contains("computed") & ~context.contains("methods") & context.contains("props")
    if kind.startswith("Cpp"):
        return ~line.rlike(r"^\s*(?://|/\*)")
    return F.lit(True)


def _kind(kind: str, line: Column, context: Column) -> Column:
    if kind == "PythonFunction":
        inside = line.startswith("    ") | line.startswith("\t")
        return F.when(inside & context.contains("@staticmethod"), "PythonStaticMethod").when(inside & context.contains("@classmethod"), "PythonClassMethod").when(inside, "PythonMethod").otherwise(kind)
    if kind == "CppFunction":
        return F.when(line.contains("static"), "CppStaticMethod").when(line.contains("virtual"), "CppVirtualMethod").otherwise(kind)
    return F.lit(kind)


def found(language: str, most_calls: int = 10) -> Column:
    """Symbols (name, kind, params, calls) of a contextual line of one language."""
    mode, patterns = fixed.SYMBOLS[language]
    line, context = F.col("line"), F.col("context")
    out = []
    for kind, pattern in patterns:
        name = F.regexp_extract(line, pattern, 1)
        if language == "markdown":
            name = F.trim(name)
            parameters = F.concat(F.lit("level "), F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1)).cast("string"))
        elif kind == "YamlValue":
            parameters = F.trim(F.regexp_extract(line, r"^[a-zA-Z0-9_-]+:\s*(.+)$", 1))
        else:
            parameters = F.lit("") if kind in fixed.WITHOUT_PARAMS else params(line)
        if kind == "PythonAsyncFunction":
            name = F.concat(F.lit("async "), name)
        called = F.array().cast("array<string>") if kind in fixed.WITHOUT_CALLS else calls(context, language, most_calls)
        symbol = F.struct(name.alias("name"), _kind(kind, line, context).alias("kind"), parameters.alias("params"), called.alias("calls"))
        good = line.rlike(pattern) & _condition(kind, context, line)
        if kind == "CppFunction":
            good = good & ~name.isin("if", "while", "for", "switch", "catch")
        out.append((good, symbol))
    if mode == "all":
        return F.array_compact(F.array(*(F.when(good, symbol) for good, symbol in out)))
    return F.array_compact(F.array(reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), reversed(out), F.lit(None))))


def scan(rows: DataFrame, language: str, most_calls: int = 10) -> DataFrame:
    """Symbols of contextual lines of one language: name, kind, params, calls beside the lines' own columns."""
    return rows.select(*rows.columns, F.inline(found(language, most_calls)))


def repo_map(files: DataFrame, text: str = "text", path: str = "file_path", most_calls: int = 10) -> DataFrame:
    """Symbols of all files of known languages outside ignored folders, in one pass over the files."""
    language = F.when(F.col(path).endswith(".vue"), "vue").otherwise(parser_language(F.col(path)))
    known = files.where(~ignored_by_map(F.col(path))).withColumn("language", language).where(F.col("language").isin(*fixed.SYMBOLS))
    rows = contextual_lines(known, text)
    every = reduce(lambda rest, name: F.when(F.col("language") == name, found(name, most_calls)).otherwise(rest), fixed.SYMBOLS, F.lit(None))
    return rows.select(*rows.columns, F.inline(every))


def kind_label(kind: Column) -> Column:
    return lookup(kind, fixed.KIND_NAMES)


def kind_icon(kind: Column) -> Column:
    return lookup(kind, fixed.KIND_ICONS)


def summary(symbols: DataFrame, path: str = "file_path") -> DataFrame:
    """(what, name, n): files, methods, files by type, symbols by kind."""
    by_file = symbols.groupBy(path).agg(F.count("*").alias("m"))
    totals = by_file.agg(F.count("*").alias("f"), F.sum("m").alias("m")).select(F.inline(F.array(F.struct(F.lit("total").alias("what"), F.lit("files").alias("name"), F.coalesce("f", F.lit(0)).alias("n")), F.struct(F.lit("total").alias("what"), F.lit("methods").alias("name"), F.coalesce("m", F.lit(0)).alias("n")))))
    types = by_file.groupBy(file_type(F.col(path)).alias("name")).agg(F.count("*").alias("n")).select(F.lit("file_type").alias("what"), "name", "n")
    kinds = symbols.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("method_type").alias("what"), kind_label(F.col("kind")).alias("name"), "n")
    return totals.unionByName(types).unionByName(kinds)


def priority(path: Column, n: Column) -> Column:
    """Entry points first, tests last, then by number of symbols."""
    first = F.when(path.contains("main") | path.contains("index") | path.contains("app"), 100).otherwise(0)
    config = F.when(path.endswith("config") | path.contains("settings"), 50).otherwise(0)
    tests = F.when(path.contains("test") | path.contains("spec"), -50).otherwise(0)
    return first + config + tests + n


def smart_sort(by_file: DataFrame, path: str = "file_path", n: str = "n") -> DataFrame:
    return by_file.withColumn("priority", priority(F.col(path), F.col(n)).cast("int")).orderBy(F.desc("priority"), path)


def page_of(by_file: DataFrame, page: int, per_page: int, path: str = "file_path", n: str = "n") -> DataFrame:
    """One page of files in smart order: the first page * per_page rows are enough for it."""
    page = max(1, page)
    top = smart_sort(by_file, path, n).limit(page * per_page)
    ranked = top.withColumn("position", F.row_number().over(W.orderBy(F.desc("priority"), path)))
    return ranked.where(F.col("position") > (page - 1) * per_page)


def page_info(total: int, page: int, per_page: int) -> dict[str, int | bool]:
    page, pages = max(1, page), -(-total // per_page)
    return {"total_files": total, "files_per_page": per_page, "current_page": page, "total_pages": pages, "has_next": page < pages, "has_previous": page > 1}


def line_estimate(symbols: DataFrame, verbosity: int = 1, path: str = "file_path") -> DataFrame:
    """Lines that the printed map takes."""
    one = F.lit(1)
    if verbosity >= 1:
        one = one + F.when(F.col("docstring").isNotNull(), 1).otherwise(0) + F.when(F.size("calls") > 0, 1).otherwise(0)
    if verbosity >= 2:
        one = one + F.size(lines(F.col("context"))) + 1
    return symbols.agg((3 + 2 * F.countDistinct(path) + F.sum(one)).alias("lines"))


def files_per_page(total_lines: int, files: int, most_lines: int) -> int:
    return max(5, most_lines // max(1, total_lines // max(1, files)))


def page_size(lines_: Column, files: Column, most_lines: int) -> Column:
    """``files_per_page`` of columns."""
    each = F.greatest(F.lit(1), F.floor(lines_ / F.greatest(F.lit(1), files)))
    return F.greatest(F.lit(5), F.floor(F.lit(most_lines) / each))


def rendered(symbols: DataFrame, verbosity: int = 1, path: str = "file_path") -> DataFrame:
    """(file_path, text): each file's part of the printed map."""
    shown = F.when(F.lit(verbosity == 0) | (F.col("params") == ""), "").otherwise(F.concat(F.lit("("), F.col("params"), F.lit(")")))
    entry = F.concat(F.lit("  "), kind_icon(F.col("kind")), F.lit(" "), F.col("name"), shown, F.lit("\n"))
    if verbosity >= 1:
        entry = F.concat(entry, F.when(F.col("docstring").isNotNull(), F.concat(F.lit("    📝 "), F.col("docstring"), F.lit("\n"))).otherwise(""), F.when(F.size("calls") > 0, F.concat(F.lit("    📞 Calls: "), F.array_join("calls", ", "), F.lit("\n"))).otherwise(""))
    if verbosity >= 2:
        entry = F.concat(entry, F.lit("    📄 Context:\n"), F.array_join(F.transform(lines(F.col("context")), lambda x: F.concat(F.lit("       "), x, F.lit("\n"))), ""))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "kind", entry.alias("entry")))), lambda x: x["entry"]), "")
    return symbols.groupBy(path).agg(F.concat(F.lit("\n📁 "), F.first(path), F.lit("\n"), parts).alias("text"))


def call_graph(symbols: DataFrame) -> DataFrame:
    """(caller, callee, callee_kind): calls that name a known symbol."""
    edges = symbols.select(F.col("name").alias("caller"), F.explode("calls").alias("callee")).distinct()
    known = symbols.select(F.col("name").alias("callee"), F.col("kind").alias("callee_kind")).distinct()
    return edges.join(known, "callee").select("caller", "callee", "callee_kind")


class PageCache:
    """Symbols of maps already made, for a while: pages of one map are cut from the same frame.

    Frames are plans, not rows; ``keep`` stores one (a checkpoint or table is best) and ``get`` gives it back while it is
    younger than ``seconds``. The least recently used of more than ``most`` is dropped.
    """

    def __init__(self, most: int = 100, seconds: float = 900.0, clock=time.monotonic):
        self.most, self.seconds, self.clock = most, seconds, clock
        self.held: dict[str, tuple[float, DataFrame]] = {}

    def keep(self, key: str, symbols: DataFrame) -> None:
        self.held.pop(key, None)
        self.held[key] = self.clock(), symbols
        while len(self.held) > self.most:
            del self.held[next(iter(self.held))]

    def get(self, key: str) -> DataFrame | None:
        at, symbols = self.held.pop(key, (float("-inf"), None))
        if symbols is None or self.clock() - at >= self.seconds:
            return None
        self.held[key] = at, symbols
        return symbols

    def page(self, key: str, page: int, per_page: int, path: str = "file_path") -> DataFrame:
        symbols = self.get(key)
        if symbols is None:
            raise KeyError(f"no such map, or it is too old: {key}")
        return page_of(symbols.groupBy(path).agg(F.count("*").alias("n")), page, per_page, path)


def languages(symbols: DataFrame, language: str = "language") -> DataFrame:
    """One row: the distinct languages of a map, in order."""
    return symbols.agg(F.array_sort(F.collect_set(language)).alias("languages"))
