"""Operator 6: near-duplicate lines by a segment-partition edit join (after Pass-Join, Li et al., VLDB 2011).

Lines within the insertions, deletions or substitutions that the shorter one's length allows (``allowed``) are linked. A
line is cut into one segment more than that, whose lengths depend on its length alone; of two linked lines, the one that is not shorter must contain some segment of the
other at a place off by no more than the edits allow. Every line is entered under its segments, by length, and probes
the segments of all lengths that are near its own. Lines that meet are verified by an edit distance of bit-parallel
columns in a band around the diagonal. The first occurrence (doc_id, text, line number) of a class of linked lines stays.

Equal lines are collapsed first, on 128 bits of hash, by which the classes know them too. The query and the pipeline look at every line that is not blank,
and link near copies by edits that grow with the length of the shorter line (``EDITS_FROM``): two edits make other words
of short lines. ``line_decisions`` by itself looks at lines of ``LEAST_CHARS`` or more, ``NEAR_CHARS`` for near copies.

Cases: a null or empty text is one empty line; a line ends at a line feed, and a carriage return belongs to the line.
Blank lines under ``LEAST_CHARS`` stay: they part paragraphs. Decisions are made for rows, known by id and text: rows
that share an id, or have none, are documents of their own, in the order of their texts' hashes; rows equal in id and
text are one document that came twice and keep the same lines. Null ids come first. Documents stay, even if no line
does. Extra columns are kept by ``apply_decisions``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import beside, checkpointed, documents, few, settled, sliced, with_hashes
from tarn.llm.components import linked_groups, probed_buckets

EDITS = 2
LEAST_CHARS, NEAR_CHARS = 20, 40
#: For all lines: the lengths from which a line may have one edit more.
EDITS_FROM = (10, 40)


def allowed(length: int, edits_from: tuple[int, ...]) -> int:
    """The edits by which a line of this length may differ from one that is not shorter."""
    return sum(length >= n for n in edits_from)


def segments(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """Start and length of the segments of a line: as equal as can be, the longer ones last."""
    short, longer = divmod(length, edits + 1)
    out, at = [], 0
    for i in range(edits + 1):
        n = short + (i >= edits + 1 - longer)
        out.append((at, n))
        at += n
    return out


def probes(length: int, edits: int = EDITS) -> list[tuple[int, int, int, int]]:
    """(other length, segment, start, length) of the substrings that a line looks up, multi-match-aware."""
    out = []
    for other in range(max(0, length - edits), length + 1):
        gap = length - other
        for i, (at, n) in enumerate(segments(other, edits)):
            low = max(0, at - i, at + gap - (edits - i))
            high = min(length - n, at + i, at + gap + (edits - i))
            out.extend((other, i, start, n) for start in range(low, high + 1))
    return out


def within(a: str, b: str, edits: int = EDITS) -> bool:
    """Whether the edit distance is ``edits`` at most: bit-parallel columns of the band of 2 * edits + 1 diagonals."""
    if abs(len(a) - len(b)) > edits:
        return False
    if len(a) < len(b):
        a, b = b, a
    first, n, m = 0, len(a), len(b)
    while first < m and a[first] == b[first]:
        first += 1
    while m > first and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[first:n], b[first:m]
    if not b:
        return len(a) <= edits
    if len(a) <= edits:
        return True  # substitute all of the shorter and add the rest
    return banded(a, b, edits) <= edits


def banded(a: str, b: str, edits: int) -> int:
    """Edit distance of a (not shorter, longer than ``edits``) and b if it is ``edits`` at most, else more.

    Column j holds the vertical differences of rows j - edits to j + edits, lowest row at the highest bit (Hyyro 2003).
    """
    width = 2 * edits + 2
    mask, top = (1 << width) - 1, 1 << (width - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    up, down = mask ^ ((1 << (width - edits - 1)) - 1), 0
    shift, distance, row = edits + 1 - width, edits, top >> 1
    # along the bottom row, which the last columns follow, a distance falls by one a column at most
    hopeless = edits + len(b) - (len(a) - edits)
    for j, c in enumerate(b):
        p = places.get(c, 0)
        match = (p >> shift if shift >= 0 else p << -shift) & mask
        shift += 1
        d0 = (((match & up) + up) ^ up | match | down) & mask
        hp = (down | ~(d0 | up)) & mask
        hn = d0 & up
        if j < len(a) - edits:
            distance += not d0 & top
        else:
            distance += bool(hp & row) - bool(hn & row)
            row >>= 1
        if distance > hopeless:
            return distance
        d0 >>= 1
        up = (hn | ~(d0 | hp)) & mask
        down = d0 & hp
    return distance


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, the text's hashes t1 and t2, line_no, line and its two hashes."""
    whole = with_hashes(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), names=("t1", "t2"))
    return with_hashes(whole.select("doc_id", "t1", "t2", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")), F.col("line"))


def entries(docs: DataFrame, edits_from: tuple[int, ...], own: bool = False) -> DataFrame:
    """(key, id): what lines look up, or (``own``) are entered under; a key is a hash of length, segment and string.

    The id is the line's ``h1``: XXH64 of its bytes with Spark's seed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, list[tuple[int, int, int]]] = {}
        for batch in batches:
            for part in sliced(batch):
                keys: list[int] = []
                ids: list[int] = []
                for line in {x for t in part.column("text").to_pylist() if t for x in t.split("\n") if len(x) >= min(edits_from)}:
                    n = len(line)
                    if n not in plans:
                        if len(plans) > 20_000:
                            plans.clear()
                        # the shorter line of a pair says how many edits there may be, and so how it is cut
                        wanted = [(n, i, at, size) for i, (at, size) in enumerate(segments(n, allowed(n, edits_from)))] if own else [p for edits in range(1, len(edits_from) + 1) for p in probes(n, edits) if allowed(p[0], edits_from) == edits]
                        plans[n] = [((length << 8 | i), 4 * at, 4 * (at + size)) for length, i, at, size in wanted]
                    data = line.encode("utf-32-le", "surrogatepass")
                    found = [xxhash.xxh64_intdigest(data[a:b], seed) for seed, a, b in plans[n]]
                    keys.extend(found)
                    ids.extend([xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)] * len(found))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.uint64()).view(pa.int64()), pa.array(ids, pa.uint64()).view(pa.int64())], ["key", "id"])

    return docs.select("text").mapInArrow(run, "key long, id long")


def sketches(lines: list[str]) -> np.ndarray:
    """256 bits for each line: which pairs of neighbouring characters it has. One edit changes four of them at most."""
    bits = np.zeros((len(lines), 256), bool)
    for row, line in zip(bits, lines):
        codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
        row[(codes[:-1] * np.uint32(0x9E3779B1) ^ codes[1:] * np.uint32(0x85EBCA77)) >> np.uint32(24)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def near_pairs(edits_from: tuple[int, ...]):
    """Of lines, the pairs (i < n, j) within the edits allowed; pairs that others connect already are passed over.

    All pairs of near lengths are compared by their sketches, in arrays; what these let through is verified.
    """

    def compare(lines: list[str], n: int) -> np.ndarray:
        order = np.array(sorted(range(len(lines)), key=lambda k: len(lines[k])), np.int64)
        lines = [lines[k] for k in order]
        sizes, early, marks = np.fromiter(map(len, lines), np.int64, len(lines)), order < n, sketches(lines)
        label, out = np.arange(len(lines)), []
        for i, line in enumerate(lines):
            edits = allowed(len(line), edits_from)
            end = int(np.searchsorted(sizes, len(line) + edits, side="right"))
            near = np.bitwise_count(marks[i + 1 : end] ^ marks[i]).sum(axis=1) <= 4 * edits
            near &= (early[i + 1 : end] | early[i]) & (label[i + 1 : end] != label[i])
            for j in (np.flatnonzero(near) + i + 1).tolist():
                if label[i] != label[j] and within(line, lines[j], edits):
                    out.append((order[i], order[j]) if early[i] else (order[j], order[i]))
                    label[label == label[j]] = label[i]
        return np.array(out, np.int64).reshape(-1, 2).T

    return compare


def line_decisions(docs: DataFrame, least_chars: int = LEAST_CHARS, edits_from: tuple[int, ...] = (NEAR_CHARS,) * EDITS) -> DataFrame:
    """One row for each line that goes: doc_id, t1, t2, line_no, near (whether the line that stays for it is another text)."""
    worded = (F.length("line") >= LEAST_CHARS) | F.col("line").rlike(r"(?U)\S")
    lines = lines_of(docs).where((F.length("line") >= least_chars) & worded)
    node = F.unhex(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in ("h1", "h2")))).alias("node")

    def texts(ids: DataFrame) -> DataFrame:
        wanted = lines.where(F.length("line") >= min(edits_from)).withColumnRenamed("h1", "id").join(ids, "id", "left_semi")
        return wanted.groupBy("id", "h2").agg(F.min("line").alias("text")).withColumnRenamed("id", "h1").select(F.col("h1").alias("id"), node, "text")

    found = linked_groups(probed_buckets(entries(docs, edits_from, own=True), entries(docs, edits_from)), texts, near_pairs(edits_from))
    hashes = lambda k: F.conv(F.substring(F.hex("id"), k, 16), 16, -10).cast("long")
    found = found.select(hashes(1).alias("h1"), hashes(17).alias("h2"), "component")
    place = F.struct("doc_id", "t1", "t2", "line_no")
    same = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    classed = same.join(found, ["h1", "h2"], "left")
    firsts = classed.where("component is not null").groupBy("component").agg(F.min("first").alias("class_first"))
    # of a class of one line that occurs once there is nothing to decide
    decided = checkpointed(classed.where("component is not null or n > 1").join(firsts, "component", "left").select("h1", "h2", F.coalesce("class_first", "first").alias("stays"), (F.coalesce("class_first", "first") != F.col("first")).alias("near")))
    there = lines.select("doc_id", "t1", "t2", "line_no", "h1", "h2").join(few(decided, 200_000), ["h1", "h2"])
    return there.where(~place.eqNullSafe(F.col("stays"))).select("doc_id", "t1", "t2", "line_no", "near")


def all_line_decisions(docs: DataFrame) -> DataFrame:
    """``line_decisions`` over every line that is not blank."""
    return line_decisions(docs, 1, EDITS_FROM)


def by_document(decisions: DataFrame) -> DataFrame:
    """doc_id, h1 and h2 (hashes of the text), gone (sorted line numbers), n_near."""
    rows = decisions.groupBy("doc_id", F.col("t1").alias("h1"), F.col("t2").alias("h2"))
    return rows.agg(F.array_sort(F.collect_set("line_no")).alias("gone"), F.count_if("near").alias("n_near"))


def apply_decisions(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """``docs`` without the lines that go; all rows and columns stay, ``n_chars`` (where there is one) is counted anew."""
    whole, untouched = F.col("_doc"), F.col("_gone").isNull()
    out = beside(docs, by_document(decisions), "left").select(whole, "_gone")
    out = settled(out, {"_lines": F.when(~untouched, F.split(whole["text"], "\n", -1))})
    out = settled(out, {"_stay": F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")})
    kept = F.array_join(F.transform("_stay", lambda i: F.get(F.col("_lines"), i)), "\n")
    out = settled(out, {"_kept": F.when(untouched, whole["text"]).otherwise(kept)})
    changed = {"text": F.col("_kept"), "n_chars": F.when(untouched, whole["n_chars"]).otherwise(F.length("_kept").cast("long")) if "n_chars" in docs.columns else None}
    return out.select(*((changed[c] if c in changed else whole[c]).alias(c) for c in docs.columns))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    gone = by_document(all_line_decisions(docs)).withColumnRenamed("doc_id", "_id")
    lines = with_hashes(docs).select("doc_id", "h1", "h2", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))
    rows = lines.join(gone, lines["doc_id"].eqNullSafe(gone["_id"]) & (lines["h1"] == gone["h1"]) & (lines["h2"] == gone["h2"]), "left")
    removed = F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit(""))
    return rows.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), removed.alias("removed_lines"))
