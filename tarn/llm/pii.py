"""Operator 7: personal data by bootstrapped contextual extraction, in DataFrame and SQL functions only.

Seeds are what patterns match (email, ip, card, phone, and keys in quotes behind an assignment), checked where the kind has
a checksum or a range. Strings that look like an identifier of some kind but do not match its pattern (a number that fails
the checksum, an address without a domain, a phone number without a country) are candidates.

Each occurrence induces lexical patterns: the one and the two words before it, the one and the two words after it, for its
kind. Patterns and identifiers form a bipartite graph, scored in rounds:

- purity of a pattern: of all places of the corpus that have its words, the part that holds something like its kind there;
- share: the mean score of the distinct identifiers that it holds (seeds have 1, candidates what the last round gave);
- trust: purity times share / ``SHARE`` (1 at most), none below ``SUPPORT`` identifiers that are known already (seeds, and
  candidates of high score: what a round finds supports patterns in the next one);
- score of a candidate: 1 less the product of the doubts of its best pattern before and its best pattern after it.

A word that is anywhere in the corpus says nothing (its purity is low), nor does one that holds numbers of which only a few
pass the check by chance (share). Candidates that end with a high score are reported as spans of their kind; the seeds'
own spans always stay.

Positions are code points: a pattern splits the text, and matches start where the pieces and matches before them end;
contexts come from those pieces. The patterns are written so that no text makes them backtrack far: possessive loops,
bounds, and a look-behind that lets a match begin only where a run of its characters begins (or the last match ended).

Cases: null texts are empty and hold nothing; repeated rows are reported each; spans of a kind do not overlap one
another; a candidate that holds a seed is no candidate; a word of more than ``CONTEXT`` characters, or one that the end of
the context cuts, is no pattern. ``redact`` hides in each row the spans of its own text, whether its id is null or other
rows have it too, and keeps extra columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarn.llm.common import beside, checkpointed, documents, settled, with_hashes

#: What the contract reports by itself; ``secret`` is reported with what the method adds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<=[=:]\x20?[\"'])[A-Fa-f0-9]{32,64}+(?=[\"'])",
}
#: Strings that look like an identifier.
SHAPES = {
    "at": r"(?:\G|(?<![^\s@|,;<>\"]))[^\s@|,;<>\"]++@[^\s@|,;<>\"]++",
    "digits": r"(?<![A-Za-z0-9@._%+-])[+(]?[0-9](?:[().\x20-]{0,3}+[0-9]){5,24}+(?![A-Za-z0-9@_])",
    "key": r"(?<![A-Za-z0-9_/+.@-])(?=[A-Za-z_-]{0,63}+[0-9])(?=[0-9_-]{0,63}+[A-Za-z])[A-Za-z0-9_-]{16,64}+(?![A-Za-z0-9_/+.@-])",
}
#: What a text must contain to hold a match at all.
CONTAINS = {"email": "@", "at": "@", "phone": "+"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Rounds over the graph; identifiers that a pattern must know; share that is enough; trust and score that count as high.
ROUNDS, SUPPORT, SHARE, TRUSTED, CONFIDENT = 4, 3, 0.3, 0.5, 0.8
#: Characters of context on either side, and what parts words.
CONTEXT, BETWEEN = 64, r"[^\p{L}\p{N}:=#_]+"
#: Patterns up to this number are broadcast to the count of their words in the corpus; more are joined by a shuffle.
FEW_PATTERNS = 50_000

#: Matches whose lengths are summed at a time, and code points of text that are cut at a time.
BLOCK, CUT = 256, 4096
SPANS = "array<struct<s:int,e:int,m:string,before:string,after:string>>"
PLAIN = "array<struct<kind:string,s:int,e:int>>"


def located(df: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """``df`` with an array of (s, e, m, before, after) for each pattern: its matches in the text, in code points, and what
    lies between them and their neighbours, ``CONTEXT`` characters at most.

    Lengths of what lies before matches are summed by blocks, so many matches in one text do not cost their square.
    """
    none = F.array().cast(SPANS)
    between = lambda q: F.struct(F.length(q).alias("n"), F.substring(q, 1, CONTEXT).alias("begin"), F.substring(q, -CONTEXT, CONTEXT).alias("end"))
    first = {}
    for name, p in patterns.items():
        there = F.col(text).rlike(p)
        if (needed := CONTAINS.get(name.strip("_"))) is not None:
            there = F.col(text).contains(needed) & there
        first[f"_m_{name}"] = F.when(there, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>"))
        first[f"_q_{name}"] = F.when(there, F.transform(F.split(text, p, -1), between)).otherwise(F.array().cast("array<struct<n:int,begin:string,end:string>>"))
    out = settled(df, first)
    out = settled(out, {f"_l_{n}": _lengths(n) for n in patterns})
    total = lambda values: F.aggregate(values, F.lit(0), lambda a, x: a + x)
    sums = {f"_b_{n}": F.when(F.size(f"_l_{n}") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(f"_l_{n}") - 1) / BLOCK).cast("int")), _block_sum(n, total))).otherwise(F.array().cast("array<int>")) for n in patterns}
    out = settled(out, sums)
    spans = {n: F.when(F.size(f"_m_{n}") > 0, F.transform(f"_m_{n}", _span(n, total))).otherwise(none) for n in patterns}
    return settled(out, spans).drop(*(f"_{x}_{n}" for x in "mqlb" for n in patterns))


def _lengths(name: str) -> Column:
    """Of each match, its length and that of what lies between it and the one before."""
    return F.zip_with(F.slice(f"_q_{name}", 1, F.size(f"_m_{name}")), f"_m_{name}", lambda q, m: q["n"] + F.length(m))


def _block_sum(name: str, total):
    return lambda b: total(F.slice(f"_l_{name}", b * BLOCK + 1, F.lit(BLOCK)))


def _span(name: str, total):
    def span(m: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        here, after = F.get(F.col(f"_q_{name}"), i), F.get(F.col(f"_q_{name}"), i + 1)
        start = total(F.slice(f"_b_{name}", F.lit(1), block)) + total(F.slice(f"_l_{name}", block * BLOCK + 1, i % BLOCK)) + here["n"]
        return F.struct(start.cast("int").alias("s"), (start + F.length(m)).cast("int").alias("e"), m.alias("m"), here["end"].alias("before"), after["begin"].alias("after"))

    return span


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""
    d = F.reverse(digits(m))
    values = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substring(d, i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(f"^(?:{OCTET}\\.){{3}}{OCTET}$"),
    "card": lambda m: F.length(digits(m)).between(13, 19) & luhn(m),
    "phone": lambda m: F.length(digits(m)).between(9, 15),
    "secret": lambda m: F.lit(True),
}


def _valid(kind: str):
    return lambda x: VALID[kind](x["m"])


def seeds(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with an array of (s, e, m, before, after) for each kind."""
    out = located(docs, {f"_{k}": PATTERNS[k] for k in ALL_KINDS}, column)
    return settled(out, {k: F.filter(f"_{k}", _valid(k)) for k in ALL_KINDS}).drop(*(f"_{k}" for k in ALL_KINDS))


def shape_kind(m: Column) -> Column:
    """The kind that a candidate would be of."""
    n = F.length(digits(m))
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike("[A-Za-z]"), "secret")
        .when(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip")
        .when(n.between(13, 19) & ~m.startswith("+"), "card")
        .when(n.between(7, 15), "phone")
    )


def holds_seed(m: Column) -> Column:
    """Whether a candidate holds what is a seed already."""
    among = lambda k: F.exists(F.regexp_extract_all(m, F.lit(PATTERNS[k]), F.lit(0)), VALID[k])
    return F.when(m.contains("@"), m.rlike(PATTERNS["email"])).when(m.rlike("[A-Za-z]"), F.lit(False)).otherwise(among("ip") | among("card") | among("phone"))


def words(text: Column) -> Column:
    """The words of a text, lower-cased, the first or last of them empty where the text begins or ends between words."""
    return F.split(F.lower(text), BETWEEN, -1)


def phrases(side: Column, before: bool) -> Column:
    """The nearest word, and the nearest two, of the text before or after an occurrence; what the cut may have cut is left out."""
    found, cut = words(side), F.length(side) >= CONTEXT
    whole = F.when(cut, F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))) if before else F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))).otherwise(found)
    whole = F.filter(whole, lambda w: w != "")
    near = F.slice(whole, F.greatest(F.size(whole) - 1, F.lit(1)), 2) if before else F.slice(whole, 1, 2)
    one = F.try_element_at(whole, F.lit(-1 if before else 1))
    return F.array_distinct(F.array_compact(F.array(one, F.when(F.size(near) == 2, F.array_join(near, " ")))))


def in_context(marked: DataFrame) -> DataFrame:
    """``marked`` (text and the seeds' columns) with ``seen``: seeds and candidates, each with the phrases before and after it."""
    out = located(marked, {f"_{k}": p for k, p in SHAPES.items()})
    loose = F.filter(F.flatten(F.array(*(f"_{k}" for k in SHAPES))), lambda x: shape_kind(x["m"]).isNotNull() & ~holds_seed(x["m"]))
    value = lambda kind, m: F.when(kind.isin("email", "secret"), F.lower(m)).otherwise(F.regexp_replace(m, "[^0-9.]", ""))

    def told(kind, seed: bool):
        def one(x: Column) -> Column:
            k = kind(x["m"])
            return F.struct(k.alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(seed).alias("seed"), value(k, x["m"]).alias("value"), phrases(x["before"], True).alias("left"), phrases(x["after"], False).alias("right"))

        return one

    known = [F.transform(k, told(lambda m, k=k: F.lit(k), True)) for k in ALL_KINDS]
    # a quoted key is of the shape of keys too
    new = F.filter(F.transform(loose, told(shape_kind, False)), lambda x: (x["kind"] != "secret") | ~F.exists("secret", lambda b: b["s"] == x["s"]))
    return settled(out, {"seen": F.concat(*known, new)}).drop(*(f"_{k}" for k in SHAPES))


def graph(occurrences: DataFrame) -> DataFrame:
    """(side, phrase, kind, value, seed, n): the patterns that hold a candidate and enough else, and how often they hold what."""
    of_side = lambda side: F.transform(side, lambda p: F.struct(F.lit(side).alias("side"), p.alias("phrase")))
    sides = F.concat(of_side("left"), of_side("right"))
    held = occurrences.select(F.inline(sides), "kind", "value", "seed").groupBy("side", "phrase", "kind", "value").agg(F.count("*").alias("n"))
    known = occurrences.groupBy("kind", "value").agg(F.max("seed").alias("seed"))
    edges = checkpointed(held.join(known, ["kind", "value"]))
    able = edges.groupBy("side", "phrase", "kind").agg(F.count("*").alias("values"), F.count_if(~F.col("seed")).alias("open")).where((F.col("values") > SUPPORT) & (F.col("open") > 0))
    return checkpointed(edges.join(able.select("side", "phrase", "kind"), ["side", "phrase", "kind"]))


def phrase_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(phrase, places): how often each of ``wanted(phrase)``, of one or two words, is anywhere in the texts."""
    out = settled(docs.select(F.coalesce("text", F.lit("")).alias("text")), {"_w": words(F.col("text"))}).select("_w")
    pairs = F.zip_with(F.slice("_w", 1, F.size("_w") - 1), F.slice("_w", 2, F.size("_w")), lambda a, b: F.concat_ws(" ", a, b))
    there = out.select(F.explode(F.concat("_w", F.when(F.size("_w") > 1, pairs).otherwise(F.array().cast("array<string>")))).alias("phrase"))
    # its size is counted; more patterns meet the words by a shuffle
    return there.join(F.broadcast(wanted) if wanted.count() <= FEW_PATTERNS else wanted, "phrase").groupBy("phrase").agg(F.count("*").alias("places"))


def scored(edges: DataFrame, places: DataFrame) -> DataFrame:
    """``edges`` with purity of the pattern and score of the identifier, after ``ROUNDS`` rounds."""
    pattern = ["side", "phrase", "kind"]
    held = edges.groupBy(*pattern).agg(F.sum("n").alias("held"))
    purity = held.join(places, "phrase", "left").select(*pattern, (F.col("held") / F.greatest("held", F.coalesce("places", F.lit(0)))).alias("purity"))
    out = checkpointed(edges.join(purity, pattern).withColumn("score", F.col("seed").cast("double")))
    for _ in range(ROUNDS):
        seen = out.groupBy(*pattern, "purity").agg(F.count_if(F.col("score") >= CONFIDENT).alias("known"), F.avg("score").alias("share"))
        trust = F.col("purity") * F.least(F.lit(1.0), F.col("share") / SHARE)
        trusted = seen.select(*pattern, F.when(F.col("known") >= SUPPORT, trust).alias("trust")).where(F.col("trust") >= TRUSTED)
        best = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("trust"))), F.lit(0.0))
        gained = out.where("not seed").join(trusted, pattern).groupBy("kind", "value").agg((1 - (1 - best("left")) * (1 - best("right"))).alias("gained"))
        out = checkpointed(out.join(gained, ["kind", "value"], "left").select(*edges.columns, "purity", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("gained", F.lit(0.0))).alias("score")))
    return out


def discovered(marked: DataFrame, docs: DataFrame, *by: str) -> DataFrame:
    """``by`` and the new spans of a text: added, an array of (kind, s, e). ``marked``: seen, and ``by``, which tell texts apart."""
    occurrences = marked.select(*by, F.inline("seen"))
    edges = graph(occurrences)
    graded = scored(edges, phrase_counts(docs, edges.select("phrase").distinct()))
    accepted = graded.where((~F.col("seed")) & (F.col("score") >= CONFIDENT)).select("kind", "value").distinct()
    new = occurrences.where("not seed").join(accepted, ["kind", "value"], "left_semi")
    keys = occurrences.where("seed and kind = 'secret'")
    return new.unionByName(keys).groupBy(*by).agg(F.array_sort(F.collect_set(F.struct("kind", "s", "e"))).alias("added"))


def marked_rows(docs: DataFrame) -> DataFrame:
    """row, doc_id, h1 and h2 of the text, seeds by kind and ``seen`` for each row, without its text."""
    plain = with_hashes(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    bare = in_context(seeds(plain)).select("doc_id", "h1", "h2", *(F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k) for k in KINDS), "seen")
    return checkpointed(bare.withColumn("row", F.monotonically_increasing_id()))


def named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, h1, h2, an array of (s, e) for each kind's seeds, and ``added``: secrets, and what the method discovers."""
    rows = marked_rows(docs)
    added = discovered(rows, docs, "row")
    return rows.join(added, "row", "left").select("doc_id", "h1", "h2", *KINDS, F.coalesce("added", F.expr(f"cast(array() as {PLAIN})")).alias("added"))


def merged_spans(found: DataFrame) -> DataFrame:
    """doc_id, h1, h2, spans: of each row's spans of all kinds, in order, those that overlap made one of the first one's kind."""
    key = ["doc_id", "h1", "h2"]
    of_kind = lambda kind: F.transform(kind, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    every = found.select(*key, F.concat(*map(of_kind, KINDS), F.col("added").cast(PLAIN)).alias("all")).where(F.size("all") > 0)
    each = every.dropDuplicates(key).select(*key, F.inline("all"))
    before = W.partitionBy(*key).orderBy("s", "e", "kind")
    opens = F.coalesce(F.col("s") >= F.max("e").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    part = each.withColumn("opens", opens.cast("int")).withColumn("part", F.sum("opens").over(before))
    joined = part.groupBy(*key, "part").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("kind", F.struct("s", "e", "kind")).alias("kind"))
    return joined.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("s", "e", "kind"))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; ``n_chars`` (where there is one) counted anew."""
    whole, touched = F.col("_doc"), F.col("_spans").isNotNull()
    out = beside(docs, merged_spans(extract(docs)), "left").select(whole, "_spans")
    # the text in blocks, so that each piece is cut from the blocks that it touches and not from the beginning
    out = settled(out, {"_blocks": F.when(touched, F.regexp_extract_all(whole["text"], F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))), "_n": F.length(whole["text"])})
    gaps = "transform(sequence(0, size(_spans)), i -> named_struct('a', if(i = 0, 0, _spans[greatest(i - 1, 0)].e), 'b', if(i = size(_spans), _n, _spans[least(i, size(_spans) - 1)].s), 'kind', if(i = size(_spans), '', concat('<', upper(_spans[least(i, size(_spans) - 1)].kind), '>'))))"
    out = settled(out, {"_gaps": F.when(touched, F.expr(gaps))})
    text_of = f"""array_join(transform(slice(_blocks, g.a div {CUT} + 1, cast((g.b + {CUT - 1}) div {CUT} - g.a div {CUT} as int)), (x, j) ->
        substring(x, cast(greatest(g.a - (g.a div {CUT} + j) * {CUT}, 0) + 1 as int), cast(least(g.b - (g.a div {CUT} + j) * {CUT}, {CUT}) - greatest(g.a - (g.a div {CUT} + j) * {CUT}, 0) as int))), '')"""
    text_of = text_of.replace("slice(_blocks, g.a", "slice(_blocks, cast(g.a").replace(" + 1, cast((g.b", " + 1 as int), cast((g.b", 1)
    clean = F.when(touched, F.expr(f"array_join(transform(_gaps, g -> concat({text_of}, g.kind)), '')")).otherwise(whole["text"])
    out = settled(out, {"_clean": clean})
    changed = {"text": F.col("_clean"), "n_chars": F.when(touched, F.length("_clean").cast("long")).otherwise(whole["n_chars"]) if "n_chars" in docs.columns else None}
    return out.select(*((changed[c] if c in changed else whole[c]).alias(c) for c in docs.columns))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract(documents(spark, sf_dir))
    added = lambda kind: F.transform(F.filter("added", lambda x: x["kind"] == kind), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    base = F.array_join(F.flatten(F.array(*(named(k, F.col(k)) for k in KINDS))), ",")
    every = F.array_join(F.flatten(F.array(*(named(k, F.array_sort(F.concat(F.col(k), added(k)))) for k in KINDS), named("secret", added("secret")))), ",")
    n_base = sum((F.size(k) for k in KINDS), F.lit(0))
    return rows.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), F.size("added").cast("long").alias("n_added"), (n_base + F.size("added")).cast("long").alias("n_spans"))
