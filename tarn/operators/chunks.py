"""Text files to chunk rows: line blocks, YAML documents, Markdown sections, HTML."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.frames import settled
from tarn.functions.text import lines

# Lines of a block, bytes of a section, lines of a plain Markdown chunk.
FALLBACK_LINES, SIMPLE_LINES, SECTION_BYTES, PLAIN_LINES = 500, 50, 3000, 500
#: Texts whose sections are Python's at once.
PART = 64


def blocks(every: Column, size: int) -> Column:
    """Array of (start_line, end_line, content), blocks of ``size`` lines of an array of them; none for an empty one.

    The array is read for each block, so it must be a column that is there, and no expression.
    """
    n = F.size(every)
    block = lambda i: F.struct(
        (i * size + 1).cast("int").alias("start_line"),
        F.least((i + 1) * size, n).cast("int").alias("end_line"),
        F.array_join(F.slice(every, (i * size + 1).cast("int"), F.lit(size)), "\n").alias("content"),
    )
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1), block)).otherwise(F.array().cast("array<struct<start_line:int,end_line:int,content:string>>"))


def fallback_chunks(files: DataFrame, text: str = "text", size: int = FALLBACK_LINES, language: str = "fallback") -> DataFrame:
    """``files`` without the text, and one row per block: ``fallback_chunk_i``; an empty file gives one ``fallback_chunk``."""
    rest = [c for c in files.columns if c != text]
    cut = settled(files, {"_lines": lines(F.col(text))})
    found = cut.select(*rest, F.posexplode_outer(blocks(F.col("_lines"), size)).alias("i", "b"))
    return found.select(
        *rest,
        F.coalesce("b.start_line", F.lit(1)).alias("start_line"),
        F.coalesce("b.end_line", F.lit(1)).alias("end_line"),
        F.when(F.col("b").isNull(), "fallback_chunk").otherwise(F.concat(F.lit("fallback_chunk_"), F.col("i").cast("string"))).alias("element_type"),
        F.lit(language).alias("language"),
        F.coalesce("b.content", F.lit("")).alias("content"),
    )


def html_chunks(files: DataFrame, text: str = "html", size: int = FALLBACK_LINES) -> DataFrame:
    return fallback_chunks(files, text, size, "html")


def element_kind(content: Column) -> Column:
    """What a block most likely holds, by the words in it."""
    has = lambda *w: F.forall(F.array(*(F.lit(x) for x in w)), lambda x: content.contains(x))
    return (
        F.when(content.contains("fn ") | content.contains("function ") | content.contains("def "), "function")
        .when(content.contains("class "), "class")
        .when(content.contains("struct "), "struct")
        .when(content.contains("enum "), "enum")
        .when(content.contains("interface "), "interface")
        .when(content.contains("impl "), "impl")
        .when(has("import ") | has("use "), "import")
        .otherwise("block")
    )


def simple_chunks(files: DataFrame, text: str = "text", size: int = SIMPLE_LINES) -> DataFrame:
    """Blocks of lines without the blank ones, each with a guessed kind."""
    rest = [c for c in files.columns if c != text]
    cut = settled(files, {"_lines": lines(F.col(text))})
    found = cut.select(*rest, F.inline(blocks(F.col("_lines"), size))).where(F.trim("content") != "")
    return found.withColumn("element_type", element_kind(F.col("content")))


def yaml_documents(files: DataFrame, text: str = "text") -> DataFrame:
    """One row for each ``---`` document that is not blank."""
    rest = [c for c in files.columns if c != text]
    parts = F.split(F.col(text), r"(?m)^---\s*$", -1)
    return files.select(*rest, F.posexplode(parts).alias("document", "content")).where(F.trim(F.regexp_replace("content", r"\s+", " ")) != "").withColumn("element_type", F.lit("document"))


HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"


def headings(files: DataFrame, text: str = "text") -> DataFrame:
    """(.., line, level, title, end_line) of ATX headings; a section ends before the next heading.

    Both are arrays within a file's row, so nothing is shuffled.
    """
    rest = [c for c in files.columns if c != text]
    every = lines(F.col(text))
    found = F.filter(F.transform(every, lambda x, i: F.struct((i + 1).alias("line"), F.length(F.regexp_extract(x, HEADING, 1)).alias("level"), F.regexp_extract(x, HEADING, 2).alias("title"))), lambda x: x["level"] > 0)
    marked = files.select(*rest, F.size(every).alias("_n"), found.alias("_h"))
    ended = F.transform("_h", lambda x, i: F.struct(x["line"].alias("line"), x["level"].alias("level"), x["title"].alias("title"), F.coalesce(F.get(F.col("_h"), i + 1)["line"] - 1, F.col("_n")).alias("end_line")))
    return marked.select(*rest, F.inline(ended))


def markdown_sections(files: DataFrame, text: str = "text", limit: int = SECTION_BYTES) -> DataFrame:
    """Sections with the headings above them in front; long ones are split at line ends, text before a heading is ``root_content``.

    Needs a stack of headings and a running length: one pass per file in Arrow batches, of which ``PART`` texts are Python's
    at a time.
    """
    rest = [c for c in files.columns if c != text]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                made = [(i, *chunk) for i, t in enumerate(part.column(len(rest))) for chunk in markdown_chunks(t.as_py(), limit)]
                own, start, end, kind, content = zip(*made) if made else ((),) * 5
                columns = [pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(kind, pa.string()), pa.array(content, pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(own, pa.int32())) for k in range(len(rest))), *columns], [*rest, "start_line", "end_line", "element_type", "content"])

    kinds = {f.name: f.dataType.simpleString() for f in files.schema}
    return files.select(*rest, text).mapInArrow(parse, ", ".join([*(f"{c} {kinds[c]}" for c in rest), "start_line int, end_line int, element_type string, content string"]))


def _split_lines(text: str) -> list[str]:
    out = text.split("\n")
    if out and out[-1] == "":
        out.pop()
    return [x.removesuffix("\r") for x in out]


def markdown_chunks(text: str | None, limit: int = SECTION_BYTES) -> list[tuple[int, int, str, str]]:
    """(start, end, type, content) of a Markdown text."""
    import re

    every = _split_lines(text or "")
    if not any(x.strip() for x in every):
        return []
    marks: list[tuple[int, int, str, int]] = []  # first line, level, title, lines of the heading
    fenced = False
    for i, line in enumerate(every):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and (m := re.match(r"(#{1,6})\s+(.+?)\s*#*\s*$", line)):
            marks.append((i, len(m[1]), m[2], 1))
        elif not fenced and i and re.match(r"(=+|-+)\s*$", line) and every[i - 1].strip() and not (marks and marks[-1][0] == i - 1):
            marks.append((i - 1, 1 if line[0] == "=" else 2, every[i - 1].strip(), 2))
    if not marks:
        out = [(s + 1, min(s + PLAIN_LINES, len(every)), "\n".join(every[s : s + PLAIN_LINES])) for s in range(0, len(every), PLAIN_LINES)]
        return [(a, b, "root_plain_text" if len(out) == 1 else f"root_plain_text_split_{k}", c) for k, (a, b, c) in enumerate(out)]
    chunks = []
    if any(x.strip() for x in every[: marks[0][0]]):
        chunks.append((1, marks[0][0], "root_content", "\n".join(every[: marks[0][0]])))
    stack: list[tuple[int, str]] = []
    for k, (at, level, title, height) in enumerate(marks):
        end = marks[k + 1][0] if k + 1 < len(marks) else len(every)
        stack = [x for x in stack if x[0] < level]
        parents = "".join(f"{'#' * lv} {t}\n" for lv, t in stack)
        stack.append((level, title))
        if not any(x.strip() for x in every[at + height : end]):
            continue
        kind = f"h{level}_section"
        whole = parents + "\n".join(every[at:end])
        if len(whole.encode()) <= limit:
            chunks.append((at + 1, end, kind, whole))
            continue
        first, size, part = at, len(parents.encode()), 0
        for i in range(at, end):
            n = len(every[i].encode()) + 1
            if size + n > limit and i > first:
                chunks.append((first + 1, i, f"{kind}_split_{part}", parents + "\n".join(every[first:i])))
                first, size, part = i, len(parents.encode()), part + 1
            size += n
        chunks.append((first + 1, end, f"{kind}_split_{part}", parents + "\n".join(every[first:end])))
    return chunks


def with_file_fields(chunks: DataFrame, path: str = "file_path", repo: str = "repo", branch: str = "branch") -> DataFrame:
    """Chunks with their id (a hash of where they are) and file extension."""
    from tarn.functions.text import extension

    place = F.concat_ws("\u0001", *(F.col(c).cast("string") for c in (repo, branch, path, "start_line", "end_line", "element_type")))
    return chunks.withColumn("chunk_id", F.sha2(place, 256)).withColumn("file_extension", extension(F.col(path)))
