"""Operator 13: three-way merge of two branches of a table of documents, by an embedded DuckDB in each hash partition.

A branch has whole rows: its columns, and its lines as ``lines array<struct<line int, added boolean, text string>>``. A line
that comes from the base names the base's line (``line``, from 0; text null: as in the base); an added line stands behind
base line ``line`` (-1: before the first). Base lines that a branch does not name are dropped there, rows that it does not
have too.

``merge`` takes aligned rows (one for each id with the three versions beside each other), each hash partition of them in
Arrow slices. A slice is registered in DuckDB, where lines and gaps of the versions meet in joins on (row, line), the gaps
in a full join, and texts are put together again by ordered string aggregation. What is compared on its own counts one:

- each column, by value; each base line; each gap between lines (the lines added there, in order): what one branch
  changed, or both alike, is clean; else it is a conflict and takes the left branch's state;
- a row of the base that a branch has dropped: a conflict (edit against deletion) if the other branch has it with a change
  in any column, line or gap, else clean. The left branch's state holds, and nothing else of the row counts;
- a row that the base does not have: clean if one branch has it, or both have the same; else a conflict of insertions.

``aligned`` brings tables together by one shuffle on the id. ``branches`` makes the two branches of the query beside their
base rows, so that texts are shuffled once and changes not at all; only the rows they add, which may meet under one id
from two documents, are shuffled by that id first, as (id, columns, mark).

Cases: nulls in columns and texts count as empty. Rows that share an id, or have none, are documents of their own in
``branches`` (equal rows give equal rows); a null id has an empty name in codes and adds no row, and neither does one whose
new id no long can hold. If rows that share an id add rows under one id, the least by columns and text is what the branch
adds. An added id that the base has too is a row of its own. ``aligned`` takes the least of the rows of a version that share
an id. An empty text has one empty line; a text all of whose lines are dropped is empty. Extra columns are ignored. An
empty table gives an empty result. A hot id or source does not matter: rows are dealt by id and input partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import documents, settled, sliced

LINES = "array<struct<line:int,added:boolean,text:string>>"
COUNTS = ("n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")
COLUMNS = ("lang", "source")
#: Bytes of text that DuckDB merges at a time, and what it may hold.
SLICE_BYTES, MEMORY = 8_000_000, "1GB"


def merge_sql(columns: Sequence[str] = COLUMNS) -> str:
    """Merges the rows of ``v(row, in_base, in_left, in_right, text, left_lines, right_lines, base_x, left_x, right_x ...)``."""
    # where a branch has dropped a base row, its parts are compared as if unchanged
    sides = ", ".join(f"if(in_base and not in_{s}, base_{c}, {s}_{c}) {s}_{c}" for c in columns for s in ("left", "right"))
    differs = lambda c, s: f"(in_base and {s}_{c} <> base_{c})"
    clean = " + ".join(f"(({differs(c, 'left')} or {differs(c, 'right')}) and (not {differs(c, 'left')} or not {differs(c, 'right')} or left_{c} = right_{c}))::int" for c in columns) or "0"
    torn = " + ".join(f"({differs(c, 'left')} and {differs(c, 'right')} and left_{c} <> right_{c})::int" for c in columns) or "0"
    taken = "".join(f", case when not in_base then if(in_left, left_{c}, right_{c}) when {differs(c, 'left')} then left_{c} else right_{c} end {c}" for c in columns)
    same = " and ".join(["left_lines = right_lines", *(f"left_{c} = right_{c}" for c in columns)])
    said = "".join(f", if(there, {c}, null) {c}" for c in columns)
    branch = lambda s: f"select row, e.line spot, e.added added, e.text text, n from (select row, unnest({s}_lines) e, unnest(range(len({s}_lines))) n from v where in_{s})"
    own = lambda s: f"select b.row, b.spot, l.row is null and b.in_{s} gone, coalesce(l.text, b.body) body from base b left join (select * from {s}_part where not added) l on l.row = b.row and l.spot = b.spot"
    gaps = lambda s: f"select row, spot, list(text order by n) texts from {s}_part where added group by row, spot"
    return f"""with base as materialized (select row, in_left, in_right, unnest(range(len(x))) spot, unnest(x) body from (select *, string_split(text, chr(10)) x from v where in_base)),
    left_part as materialized ({branch("left")}), right_part as materialized ({branch("right")}),
    lines as materialized (
        select b.row, b.spot, l.gone left_gone, r.gone right_gone, l.body left_line, r.body right_line, l.gone or l.body <> b.body left_new, r.gone or r.body <> b.body right_new
        from base b full join ({own("left")}) l on l.row = b.row and l.spot = b.spot full join ({own("right")}) r on r.row = b.row and r.spot = b.spot),
    gaps as materialized (select coalesce(l.row, r.row) row, coalesce(l.spot, r.spot) spot, l.texts left_texts, r.texts right_texts
        from ({gaps("left")}) l full join ({gaps("right")}) r on r.row = l.row and r.spot = l.spot),
    counts as (select row, sum(clean) clean, sum(torn) torn, sum(cut) cut, sum(met) met from (
        select row, ((left_new or right_new) and (not left_new or not right_new or (left_gone and right_gone) or (not left_gone and not right_gone and left_line = right_line)))::int clean,
            (left_new and right_new and not left_gone and not right_gone and left_line <> right_line)::int torn, (left_new and right_new and left_gone <> right_gone)::int cut, 0 met from lines
        union all select row, (left_texts is null or right_texts is null or left_texts = right_texts)::int, 0, 0, (left_texts is not null and right_texts is not null and left_texts <> right_texts)::int from gaps) group by row),
    texts as (select row, string_agg(text, chr(10) order by spot, behind, n) text from (
        select row, spot, 0 behind, 0 n, if(left_new, left_line, right_line) text from lines where not if(left_new, left_gone, right_gone)
        union all select row, spot, 1, unnest(range(len(coalesce(left_texts, right_texts)))), unnest(coalesce(left_texts, right_texts)) from gaps) group by row),
    sides as (select row, in_base, in_left, in_right, left_lines, right_lines{"".join(f", base_{c}" for c in columns)}, {sides or "0 none"} from v),
    parts as (select row, in_base, in_left, in_right, {clean} column_clean, {torn} column_torn, {same} same{taken} from sides),
    judged as (select p.*, column_clean + coalesce(c.clean, 0) all_clean, column_torn + coalesce(c.torn, 0) all_torn, coalesce(c.cut, 0) all_cut, coalesce(c.met, 0) all_met, t.text,
        in_base and in_left and in_right whole, in_base and (in_left <> in_right) and column_clean + coalesce(c.clean, 0) > 0 lost
        from parts p left join counts c using (row) left join texts t using (row)),
    done as (select *, whole or not in_base or (lost and in_left) there, not in_base and in_left and in_right and not same clash from judged)
    select row{said}, if(there, coalesce(text, ''), null) text,
        case when whole then all_clean else (not lost and not clash)::int end::bigint n_clean, if(whole, all_torn, 0)::bigint n_edit_edit,
        case when whole then all_cut else lost::int end::bigint n_edit_delete, case when whole then all_met else clash::int end::bigint n_insert_insert
    from done order by row"""


def merge(versions: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """doc_id, the columns and text (null: the row is gone) and the counts for each of the aligned rows ``versions``.

    ``versions`` has doc_id, in_base, in_left, in_right, text (the base's), left_lines, right_lines and base_x, left_x,
    right_x for each column x; what a version lacks is null there.
    """
    sql = merge_sql(columns)
    names = ["doc_id", *columns, "text", *COUNTS]
    kind = versions.schema["doc_id"].dataType.simpleString()
    wanted = ["doc_id", "in_base", "in_left", "in_right", "text", "left_lines", "right_lines", *(f"{s}_{c}" for c in columns for s in ("base", "left", "right"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # nothing of DuckDB's goes to a disk: a slice is bounded
        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}) as db:
            for batch in batches:
                for part in sliced(batch, SLICE_BYTES):
                    table = pa.Table.from_batches([part])
                    db.register("v", table.drop_columns("doc_id").append_column("row", pa.array(range(part.num_rows), pa.int64())))
                    out = db.sql(sql).to_arrow_table().combine_chunks()
                    db.unregister("v")
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(out.column(n).combine_chunks().cast(pa.int64() if n in COUNTS else pa.string()) for n in names[1:])], names)

    schema = ", ".join([f"doc_id {kind}", *(f"{c} string" for c in (*columns, "text")), *(f"{c} long" for c in COUNTS)])
    return versions.select(*wanted).mapInArrow(run, schema)


def aligned(base: DataFrame, left: DataFrame, right: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """Rows for ``merge`` from a base table (doc_id, columns, text) and two branches (doc_id, columns, lines)."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    body = {"base": F.coalesce("text", F.lit("")).alias("text"), "left": F.coalesce("lines", F.array().cast(LINES)).alias("lines")}
    body["right"] = body["left"]
    tagged = None
    for name, table in (("base", base), ("left", left), ("right", right)):
        one = table.select("doc_id", F.struct(*map(value, columns), body[name]).alias(name))
        tagged = one if tagged is None else tagged.unionByName(one, allowMissingColumns=True)
    met = tagged.groupBy("doc_id").agg(*(F.min(s).alias(s) for s in ("base", "left", "right")))
    flags = [F.col(s).isNotNull().alias(f"in_{s}") for s in ("base", "left", "right")]
    return met.select("doc_id", *flags, F.col("base.text").alias("text"), F.col("left.lines").alias("left_lines"), F.col("right.lines").alias("right_lines"), *(F.col(s)[c].alias(f"{s}_{c}") for c in columns for s in ("base", "left", "right")))


def code(branch: str, name: Column | str) -> Column:
    """What a branch does to a part of a document (0 to 16)."""
    name = F.lit(name) if isinstance(name, str) else name
    return F.crc32(F.concat(F.lit(f"{branch}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), name)) % 17


def line_code(branch: str) -> Callable[[Column, Column], Column]:
    return lambda _, i: code(branch, i.cast("string")).cast("int")


def branches(docs: DataFrame) -> DataFrame:
    """Rows for ``merge``: ``docs`` (hash partitioned) beside branches L and R, which edit it by ``code``, and the rows they add."""
    value = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    own = docs.select("doc_id", *map(value, (*COLUMNS, "text")))
    # a hot id is as many rows to deal as there are input partitions that have it
    rows = own.repartition("doc_id", F.spark_partition_id())
    rows = settled(rows, {"_lines": F.split("text", "\n", -1)})
    rows = settled(rows, {f"_{b}": F.transform("_lines", line_code(b)) for b in "LR"})
    entry = lambda at, added, text: F.struct(at.alias("line"), F.lit(added).alias("added"), text.cast("string").alias("text"))
    out = [F.col("doc_id"), F.lit(True).alias("in_base"), F.col("text")]
    for b, side in (("L", "left"), ("R", "right")):
        line = lambda c, i: (
            F.when(c == 0, F.array().cast(LINES))
            .when(c <= 2, F.array(entry(i, False, F.concat(F.get("_lines", i), F.when(c == 1, "!").otherwise("?")))))
            .when(c <= 4, F.array(entry(i, False, F.lit(None)), entry(i, True, F.when(c == 3, "!").otherwise("?"))))
            .otherwise(F.array(entry(i, False, F.lit(None))))
        )
        there = code(b, "row") != 0
        out += [there.alias(f"in_{side}"), F.when(there, F.flatten(F.transform(f"_{b}", line))).alias(f"{side}_lines")]
        for c in COLUMNS:
            edit = code(b, c)
            out.append(F.when(there, F.when(edit == 0, "").when(edit == 1, F.concat(c, F.lit("!"))).when(edit == 2, F.concat(c, F.lit("?"))).otherwise(F.col(c))).alias(f"{side}_{c}"))
    out += [F.col(c).alias(f"base_{c}") for c in COLUMNS]
    return rows.select(*out).unionByName(added_rows(own))


def added_rows(own: DataFrame) -> DataFrame:
    """The rows that L and R add, met by their ids."""
    new = None
    for b, side, step in (("L", "left", -1), ("R", "right", -5)):
        mark = F.when(code(b, "row") == 3, "!").when(code(b, "row") == 4, "?")
        one = own.select(F.try_subtract(F.lit(step).cast("long"), F.col("doc_id")).alias("doc_id"), F.struct(*COLUMNS, mark.alias("mark")).alias(side)).where(f"doc_id is not null and {side}.mark is not null")
        new = one if new is None else new.unionByName(one, allowMissingColumns=True)
    met = new.groupBy("doc_id").agg(F.min("left").alias("left"), F.min("right").alias("right"))
    lines = lambda s: F.when(F.col(s).isNotNull(), F.array(F.struct(F.lit(-1).alias("line"), F.lit(True).alias("added"), F.col(f"{s}.mark").alias("text"))))
    flags = [F.lit(False).alias("in_base"), *(F.col(s).isNotNull().alias(f"in_{s}") for s in ("left", "right"))]
    return met.select("doc_id", *flags, F.lit(None).cast("string").alias("text"), lines("left").alias("left_lines"), lines("right").alias("right_lines"), *(F.lit(None).cast("string").alias(f"base_{c}") for c in COLUMNS), *(F.col(s)[c].alias(f"{s}_{c}") for c in COLUMNS for s in ("left", "right")))


def op13_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge(branches(documents(spark, sf_dir)))
    return merged.select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"), *COUNTS)
