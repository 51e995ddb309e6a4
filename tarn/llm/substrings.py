"""Operator 11: removal of repeated passages by compressed FM-indices over shards of the corpus.

A window is ``width`` consecutive words of one document; it repeats if the same words also begin earlier. Words covered by
a repeating window go.

Candidates. The key of a window is the least hash of its runs of four words, so equal windows have equal keys. Successive
windows of one key are a segment. A segment whose key occurs nowhere else, and once in itself, holds no repeating window.
Keys are counted; those that count more than once are kept in a Bloom filter of bounded size (``FILTER_BITS``), and only
segments that pass it go further. Where the corpus has more shared keys than the filter can tell, more segments pass, all
of them at worst: that costs time, never a result.

Segments that pass are dealt to shards by key. Of segments with equal words the first represents all others, whose windows
all repeat. A key that counts more than ``CROWD`` times (a passage in many documents, its edges in as many surroundings)
would crowd a shard: its segments are taken apart into windows, one for each wording in a task, which are dealt by
their own words. Such keys are a second filter of the same kind.

Shards. A task numbers its words and builds an FM-index of its segments, in the order of the corpus: the Burrows-Wheeler
transform by suffixes sorted to the width, in a wavelet matrix of bits with ranks for each 64. All segments are then
streamed through it: from each window's last word, backward search extends the match to the left, for all windows at once,
while it occurs more than once: matching statistics up to the threshold. Windows that reach the threshold report their
interval; the first to report an interval is the first occurrence, all later ones repeat. Hashes only route: words are
compared as words.

Documents then meet the masks of their representatives (texts are shuffled once), find their segments again, and lose the
words of windows that repeat: those of masks, and all of segments that pass and represent nothing.

Cases: a null or empty text has no words. Documents with fewer words than the width lose none. Rows that share an id are
ordered by a hash of their text, rows without one come last in the order of such hashes; rows equal in id and text are one
document, and lose the same words. Long runs of one word are cut to segments of 64 windows. Extra columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import checkpointed, documents, map_batches, sliced

WIDTH, GRAM = 20, 4
#: Windows of a segment at most: as many as a mask has bits.
RUN = 63
#: Times that a key may count and still be dealt whole; segments of a shard.
CROWD, SHARD = 4096, 40_000
#: Bits of a filter: so many for each key, and at most.
KEY_BITS, FILTER_BITS = 12, 1 << 28
#: Windows of crowded keys that a task holds to send each wording once.
HELD = 100_000
#: Bytes whose words are hashed together; longer words are hashed on their own.
REGION = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    up = np.full(REGION + 1, BASE, np.uint64)
    down = np.full(REGION + 1, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that stand one after another in ``data``; none crosses an offset."""
    ink = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = ink.copy()
    starts[1:] &= ~ink[:-1] | edge[1:-1]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word: a polynomial of its bytes, mixed."""
    up, down = powers()
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        low = starts[first]
        last = int(np.searchsorted(ends, low + REGION, side="right"))
        if last <= first:
            out[first] = int.from_bytes(hashlib.blake2b(data[low : ends[first]].tobytes(), digest_size=8).digest(), "little")
            first += 1
            continue
        high = ends[last - 1]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        s, e = starts[first:last] - low, ends[first:last] - low
        out[first:last] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        first = last
    return out


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` numbers."""
    size = 1
    while size < width:
        step = min(size, width - size)
        x = np.minimum(x[:-step], x[step:])
        size += step
    return x


def segments_of(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(text, key, start, windows, times) of the segments of texts one after another, starts counted in words of the text.

    times: 2 if the run of words that the key is the hash of occurs more than once in the segment (so that two of its
    windows may be equal), else 1.
    """
    starts, ends = word_spans(data, offsets)
    words = np.searchsorted(starts, offsets)
    none = np.empty(0, np.int64)
    if len(starts) < width:
        return (none,) * 5
    h = word_hashes(data, starts, ends)
    grams = h[: len(h) - GRAM + 1].copy()
    for k in range(1, GRAM):
        grams = grams * BASE + h[k : len(h) - GRAM + 1 + k]
    grams = mixed(grams)
    inner = width - GRAM + 1
    key = least_of(grams, inner)
    text = np.searchsorted(words, np.arange(len(starts)), side="right") - 1
    whole = text[: len(key)] == text[width - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return (none,) * 5
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (key[at[1:]] != key[at[:-1]]) | (text[at[1:]] != text[at[:-1]])
    run = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    new |= (np.arange(len(at)) - run) % RUN == 0
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    begin = at[first]
    own = key[begin]
    sent = mixed(own)  # the least of many hashes is a small number
    head = np.argmax(grams[begin[:, None] + np.arange(inner)] == own[:, None], axis=1) + begin
    tail = begin + n + inner - 2 - np.argmax(grams[(begin + n + inner - 2)[:, None] - np.arange(inner)] == own[:, None], axis=1)
    return text[begin], sent.view(np.int64), begin - words[text[begin]], n, 1 + (head < tail)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts without nulls, and where each begins."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text and what a row is known and ordered by: no_id, d, h."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    return rows.select("doc_id", F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(11), "text")).alias("d"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("h"), "text")


def keys_of(rows: DataFrame, width: int) -> DataFrame:
    """The keys of all segments, as often as they count."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, key, _, _, times = segments_of(*flat(batch.column("text")), width)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(key, times), pa.int64())], ["key"])

    return map_batches(rows.select("text"), kernel, "key long")


class KeyFilter:
    """A Bloom filter of 64-bit keys with two bits a key, made of Spark's bitmaps; 32 MB at most."""

    def __init__(self, keys: DataFrame, n: int):
        self.size = min(FILTER_BITS, 1 << max(15, (KEY_BITS * n).bit_length()))
        self.bits = np.zeros(self.size // 8, np.uint8)
        if n:
            spot = F.explode(F.array(*(F.pmod(k, F.lit(self.size)) for k in ("key", F.shiftrightunsigned("key", 32)))))
            made = keys.select(spot.alias("spot")).groupBy(F.expr("spot div 32768").alias("block")).agg(F.bitmap_construct_agg(F.col("spot") % 32768).alias("map"))
            for r in made.collect():  # 8192 blocks at most
                self.bits[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(r["map"], np.uint8)

    def holds(self, key: np.ndarray) -> np.ndarray:
        key = key.view(np.uint64)
        has = np.ones(len(key), bool)
        for spot in (key, key >> np.uint64(32)):
            spot = spot & np.uint64(self.size - 1)
            has &= (self.bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return has


class FmIndex:
    """Backward search, to a depth, in a text of numbers from 0 (which may end a match only)."""

    def __init__(self, text: np.ndarray, depth: int):
        self.size, top = len(text), int(text.max())
        self.bits = max(1, top.bit_length())
        order = np.argsort(self.ranks(text, depth), kind="stable")
        before = text[order - 1]
        self.first = np.searchsorted(np.sort(text), np.arange(top + 2))
        self.levels = []
        for level in reversed(range(self.bits)):
            one = (before >> level & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            packed = np.pad(packed, (0, -len(packed) % 8 + 8)).view(np.uint64)
            ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]])
            self.levels.append((packed, ranks, self.size - int(one.sum())))
            before = np.concatenate([before[~one], before[one]])
        self.base = self._descend(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def ranks(self, text: np.ndarray, depth: int) -> np.ndarray:
        """Order of the suffixes by their first ``depth`` numbers."""
        size = min(depth, 62 // self.bits)
        padded = np.concatenate([text, np.zeros(depth, text.dtype)])
        key = np.zeros(self.size, np.int64)
        for k in range(size):
            key = key << self.bits | padded[k : k + self.size]
        while size < depth:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            step = min(size, depth - size)
            after = np.concatenate([key[step:], np.full(min(step, self.size), -1)])[: self.size]
            key = key * (self.size + 1) + after + 1
            size += step
        return key

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (packed, ranks, zeros) in zip(reversed(range(self.bits)), self.levels):
            word = at >> 6
            ones = ranks[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of matches with one more number on the left."""
        start = self.first[symbol] - self.base[symbol]
        return start + self._descend(symbol, low), start + self._descend(symbol, high)

    def matches(self, text: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For matches that end at ``ends``: their greatest length that occurs twice (``depth`` at most), and the interval's start."""
        length, start = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
        who = np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size)
        for k in range(depth):
            symbol = text[ends[who] - k]
            low, high = (self.first[symbol], self.first[symbol + 1]) if k == 0 else self.extend(symbol, low, high)
            more = high - low >= 2
            who, low, high = who[more], low[more], high[more]
            if not len(who):
                break
            length[who], start[who] = k + 1, low
        return length, start


def repeating(texts: list[bytes], width: int) -> np.ndarray:
    """For segments in the order of the corpus: masks of the windows that repeat an earlier window of theirs."""
    numbers: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    lengths = np.array([len(w) for w in split])
    words = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for t in split for w in t), np.int64, lengths.sum())
    stops = np.cumsum(lengths)
    text = np.insert(words, stops, 0)
    begins = stops - lengths + np.arange(len(texts))
    n = lengths - width + 1
    segment = np.repeat(np.arange(len(texts)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    length, start = FmIndex(text, width).matches(text, begins[segment] + offset + width - 1, width)
    full = np.flatnonzero(length >= width)
    later = np.ones(len(full), bool)
    later[np.unique(start[full], return_index=True)[1]] = False
    masks = np.zeros(len(texts), np.int64)
    np.bitwise_or.at(masks, segment[full[later]], np.int64(1) << offset[full[later]])
    return masks


AT = ["no_id", "d", "h", "start"]
UNIT = "route long, words binary, no_id boolean, d long, h long, start int"


def units(rows: DataFrame, shared, crowded, width: int) -> DataFrame:
    """Segments that pass ``shared``, and the windows of those that pass ``crowded`` (route: null), with words and place.

    ``shared`` and ``crowded`` are broadcast filters.
    """

    def batch_of(found: dict[tuple, tuple]) -> pa.RecordBatch:
        route, words = zip(*found)
        columns = [pa.array(route, pa.int64()), pa.array(words, pa.binary()), *map(pa.array, zip(*found.values()))]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()))], ["route", "words", *AT])

    def add(found: dict[tuple, tuple], name: tuple, at: tuple) -> None:
        if name not in found or at < found[name]:
            found[name] = at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        for batch in batches:
            for part in sliced(batch):
                text, key, start, n, _ = segments_of(*flat(part.column("text")), width)
                some = np.flatnonzero(shared.value.holds(key))
                apart = crowded.value.holds(key[some]).tolist()
                texts, places = part.column("text").cast(pa.large_binary()), list(zip(*(part.column(c).to_pylist() for c in AT[:3])))
                found: dict[tuple, tuple] = {}
                last, words = -1, []
                for i, k, s, m, taken in zip(text[some].tolist(), key[some].tolist(), start[some].tolist(), n[some].tolist(), apart):
                    if i != last:
                        last, words = i, texts[i].as_py().split()
                    if taken:
                        for at in range(s, s + m):
                            add(held, (None, b" ".join(words[at : at + width])), (*places[i], at))
                    else:
                        add(found, (k, b" ".join(words[s : s + m + width - 1])), (*places[i], s))
                if found:
                    yield batch_of(found)
                if len(held) > HELD:
                    yield batch_of(held)
                    held = {}
        if held:
            yield batch_of(held)

    return rows.select(*AT[:3], "text").mapInArrow(run, UNIT)


def masks(found: DataFrame, shards: int, width: int) -> DataFrame:
    """d, h, start, n, mask of the representatives of equal units."""

    def index(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in AT])
        firsts: dict[bytes, int] = {}
        for i, words in enumerate(table.column("words").to_pylist()):
            firsts.setdefault(words, i)
        at = table.take(pa.array(firsts.values(), pa.int64()))
        n = pa.array([w.count(b" ") - width + 2 for w in firsts], pa.int32())
        return pa.table([*(at.column(c) for c in AT[1:]), n, pa.array(repeating(list(firsts), width), pa.int64())], ["d", "h", "start", "n", "mask"])

    shard = F.pmod(F.coalesce("route", F.xxhash64("words")), F.lit(shards))
    return found.select(shard.alias("shard"), "words", *AT).groupBy("shard").applyInArrow(index, "d long, h long, start int, n int, mask long")


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by spaces) of each row."""
    rows = rows_of(docs)
    shared = checkpointed(keys_of(rows, width).groupBy("key").count().where("count > 1"))
    size = shared.agg(F.count("*").alias("n"), F.count_if(F.col("count") > CROWD).alias("crowds"), F.sum("count").alias("segments")).first()
    send = docs.sparkSession.sparkContext.broadcast
    passing = send(KeyFilter(shared, size["n"]))  # bounded by ``FILTER_BITS``, like the next
    crowded = send(KeyFilter(shared.where(F.col("count") > CROWD), size["crowds"]))
    known = masks(units(rows, passing, crowded, width), max(1, -(-(size["segments"] or 0) // SHARD)), width)
    # as many as a document has
    judged = known.groupBy("d", "h").agg(F.collect_list(F.struct("start", "n", "mask")).alias("masks"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "n_removed", "kept"]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("text")
        text, key, start, n, _ = segments_of(*flat(column), width)
        some = passing.value.holds(key)
        text, start, n = text[some], start[some].tolist(), n[some].tolist()
        bounds = np.searchsorted(text, np.arange(len(column) + 1)).tolist()
        total, removed, kept = [], [], []
        for i, (t, known) in enumerate(zip(column.cast(pa.large_binary()).to_pylist(), batch.column("masks").to_pylist())):
            words = t.split()
            total.append(len(words))
            if bounds[i] < bounds[i + 1]:
                repeats = np.zeros(len(words) + 1, np.int8)
                for k in range(bounds[i], bounds[i + 1]):  # all windows of what does not represent its words
                    repeats[start[k] : start[k] + n[k]] = 1
                for m in known or []:
                    repeats[m["start"] : m["start"] + m["n"]] = (m["mask"] >> np.arange(m["n"])) & 1
                at = np.flatnonzero(repeats)
                covered = np.zeros(len(words) + 1, np.int64)
                covered[at] += 1
                covered[at + width] -= 1
                words = [words[k] for k in np.flatnonzero(np.cumsum(covered)[:-1] == 0).tolist()] if len(at) else words
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names)

    whole = rows.join(judged.hint("shuffle_hash"), ["d", "h"], "left")
    return map_batches(whole.select("doc_id", "masks", "text"), kernel, f"doc_id {kind}, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
