"""Operator 1: SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

A text is normalised (dummy prefix, spaces to U+2581), cut where no piece of the vocabulary can cross, and each
segment is merged by an agenda of adjacent symbol pairs: highest score first, leftmost among equals. Short segments
of a batch share one array-backed agenda (each round pops every segment's best pair); long ones use a heap. Merged
segments are remembered in a bounded memo. What an Arrow slice adds to the memo is checked, id by id, against the
sentencepiece library, and the library decodes; a difference raises.

A model of another type, with a normaliser of its own or with user-defined pieces is refused.

Cases: a null text is an empty one and has no ids; empty texts give no ids and decode to an empty text. Repeated rows
are encoded each; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tarn.llm.common import documents, map_batches

SPACE = "▁"
#: Segments of more symbols than this use the heap, whose cost grows as n log n.
LONG = 48
#: Segments that the memo of one worker holds; it is emptied when full, which changes no result.
MEMO = 400_000
NORMAL, USER_DEFINED = 1, 4


class MergeVocabulary:
    """Pieces, scores and merge table of a BPE model file."""

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only merge-type vocabularies with the identity normaliser are supported")
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        if any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("vocabularies with user-defined pieces are not supported")
        pieces = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == NORMAL]
        self.ids = {piece: i for i, piece, _ in pieces}
        self.n_pieces = len(model.pieces)
        self.byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if model.trainer_spec.byte_fallback else None
        self.unknown = self.library.unk_id()
        # symbols: pieces by id; single characters of pieces that are no piece themselves follow
        self.symbols = dict(self.ids)
        for c in sorted({c for _, p, _ in pieces for c in p} - set(self.symbols)):
            self.symbols[c] = self.n_pieces + len(self.symbols)
        self.width = 1 + max(self.symbols.values())
        scores = np.full(self.width, -np.inf)
        merges = {}
        for i, piece, score in pieces:
            scores[i] = score
            for k in range(1, len(piece)):
                left, right = self.symbols.get(piece[:k]), self.symbols.get(piece[k:])
                if left is not None and right is not None:
                    merges[left * self.width + right] = i
        self.merges, self.scores = merges, scores
        # the same table for arrays: open addressing, no more than an eighth full
        self.bits = max(16, (8 * len(merges)).bit_length())
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        homes = self.home(np.array(list(merges), np.int64)).tolist()
        for at, (key, piece) in zip(homes, merges.items()):
            while self.keys[at] >= 0:
                at = (at + 1) & (1 << self.bits) - 1
            self.keys[at], self.made[at] = key, piece
        self.by_code = np.full(0x110000, -1, dtype=np.int32)
        for c, s in self.symbols.items():
            if len(c) == 1:
                self.by_code[ord(c)] = s
        inner = {c for _, p, _ in pieces if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in inner)
        crossed = any(a != SPACE and b == SPACE for _, p, _ in pieces for a, b in zip(p, p[1:]))
        word = f"[^{alone}]+" if crossed else f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+"
        self.segments = re.compile(f"{word}|[{alone}]" if alone else word)
        self.memo: dict[str, bytes] = {}
        self.fence = next((chr(c) for c in (10, *range(128)) if chr(c) not in inner), "")

    def ids_of(self, symbol: int, text: str) -> Iterable[int]:
        """Final ids of a symbol: its own, or those of its bytes."""
        if 0 <= symbol < self.n_pieces:
            return (symbol,)
        return map(self.byte_ids.__getitem__, text.encode()) if self.byte_ids else (self.unknown,)

    def merge_long(self, segment: str) -> list[int]:
        """One segment by a heap of adjacent pairs."""
        syms = [self.symbols.get(c, -1) for c in segment]
        text = list(segment)
        before, after = list(range(-1, len(syms) - 1)), [*range(1, len(syms)), -1]
        agenda: list[tuple[float, int, int, int, int]] = []

        def propose(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and syms[i] >= 0 and syms[j] >= 0 and (made := self.merges.get(syms[i] * self.width + syms[j])) is not None:
                heapq.heappush(agenda, (-self.scores[made], i, j, syms[i], syms[j]))

        for i in range(len(syms) - 1):
            propose(i, i + 1)
        while agenda:
            _, i, j, left, right = heapq.heappop(agenda)
            if syms[i] != left or syms[j] != right or after[i] != j:
                continue  # one side has been merged since
            syms[i], syms[j] = self.merges[left * self.width + right], -2
            text[i] += text[j]
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            propose(before[i], i)
            propose(i, after[i])
        return list(chain.from_iterable(self.ids_of(s, t) for s, t in zip(syms, text) if s != -2))

    def home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Symbols that pairs merge into, -1 for none."""
        key = left.astype(np.int64) * self.width + right
        key[(left < 0) | (right < 0)] = -2  # found nowhere
        at = self.home(key)
        there = self.keys[at]
        out = np.where(there == key, self.made[at], -1)
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while open_.size:
            at[open_] = (at[open_] + 1) & (1 << self.bits) - 1
            there = self.keys[at[open_]]
            out[open_] = np.where(there == key[open_], self.made[at[open_]], -1)
            open_ = open_[(there != key[open_]) & (there >= 0)]
        return out

    def merge_many(self, segments: list[str]) -> list[bytes]:
        """Packed ids of many short segments: in each round every segment pops its best pair."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        sym, seg = self.by_code[codes], np.repeat(np.arange(len(segments)), lengths)
        code = codes.astype(np.int64)
        last = np.append(seg[1:] != seg[:-1], True)
        made = np.full(len(sym), -1, np.int32)
        made[:-1] = np.where(last[:-1], -1, self.pair(sym[:-1], sym[1:]))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            score = np.where(made >= 0, self.scores[made], -np.inf)
            best = np.maximum.reduceat(score, starts)
            size = np.diff(np.append(starts, len(sym)))
            going = np.repeat(best > -np.inf, size)
            if not going.all():
                ended = ~going
                done.append((seg[ended], sym[ended], code[ended]))
                seg, sym, code, made, score = seg[going], sym[going], code[going], made[going], score[going]
                size, best = size[best > -np.inf], best[best > -np.inf]
                if not len(sym):
                    break
            top = np.flatnonzero(score == np.repeat(best, size))
            top = top[np.append(True, seg[top][1:] != seg[top][:-1])]  # the leftmost of each segment
            sym[top] = made[top]
            keep = np.ones(len(sym), bool)
            keep[top + 1] = False
            top = top - np.arange(len(top))  # one symbol before it has gone for each segment
            seg, sym, code, made = seg[keep], sym[keep], code[keep], made[keep]
            same = np.append(seg[1:] == seg[:-1], False)
            for at in (top, top[top > 0] - 1):
                inside = same[at]
                made[at] = -1
                at = at[inside]
                made[at] = self.pair(sym[at], sym[at + 1])
        seg, sym, code = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(seg, kind="stable")
        seg, sym, code = seg[order], sym[order], code[order]
        odd = (sym < 0) | (sym >= self.n_pieces)
        if odd.any():  # characters that are no piece, and were therefore never merged
            parts = [np.array(list(self.ids_of(-1, chr(c))), np.int32) for c in code[odd].tolist()]
            sizes = np.ones(len(sym), np.int64)
            sizes[odd] = list(map(len, parts))
            seg, full = np.repeat(seg, sizes), np.repeat(sym, sizes)
            full[np.repeat(odd, sizes)] = np.concatenate(parts)
            sym = full
        bounds, data = (4 * np.searchsorted(seg, np.arange(len(segments) + 1))).tolist(), sym.astype(np.int32).tobytes()
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]

    def check(self, segments: list[str], packed: list[bytes]) -> None:
        """Raises if the library has other ids for any of the segments.

        What is before a segment in a text cannot merge with it; for the library it stands behind the dummy prefix if it
        begins with that, else behind a character that merges with nothing.
        """
        lead = len(self.library.encode(self.fence))
        fenced = [not s.startswith(SPACE) or not self.prefix for s in segments]
        theirs = self.library.encode([self.fence + s if f else s[1:] for s, f in zip(segments, fenced)], out_type=int, num_threads=1)
        theirs = [ids[lead:] if f else ids for ids, f in zip(theirs, fenced)]
        total = sum(map(len, theirs))
        if np.fromiter(chain.from_iterable(theirs), np.int32, total).tobytes() != b"".join(packed):
            wrong = next(s for s, own, ids in zip(segments, packed, theirs) if own != np.array(ids, np.int32).tobytes())
            raise ValueError(f"ids differ from the library's for {wrong[:80]!r}")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. Segments that the memo lacks are merged, checked and remembered."""
        cut = [self.segments.findall((self.prefix + t).replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        fresh = list(set(chain.from_iterable(cut)).difference(self.memo))
        short, long = [s for s in fresh if len(s) <= LONG], [s for s in fresh if len(s) > LONG]
        made = dict(zip(short, self.merge_many(short))) if short else {}
        made |= {s: np.array(self.merge_long(s), np.int32).tobytes() for s in long}
        self.memo.update(made)
        made.pop(SPACE, None)  # the library has no text for a prefix alone
        self.check(list(made), list(made.values()))
        out = [np.frombuffer(b"".join(map(self.memo.__getitem__, words)), np.int32).tolist() for words in cut]
        for s in long:
            del self.memo[s]
        return out


@lru_cache(maxsize=2)
def vocabulary(model_path: str) -> MergeVocabulary:
    return MergeVocabulary(model_path)


def full(ids: list[list[int]], decoded: list[str]) -> list[pa.Array]:
    return [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]


@lru_cache(maxsize=1)
def decimals(n: int) -> list[str]:
    return list(map(str, range(n)))


def digests(ids: list[list[int]], decoded: list[str]) -> list[pa.Array]:
    name = decimals(1 + max(map(max, filter(None, ids)), default=0) | 0xFFFF).__getitem__
    listed = [hashlib.sha256(",".join(map(name, x)).encode()).hexdigest() for x in ids]
    return [pa.array(map(len, ids), pa.int64()), pa.array(listed, pa.string()), pa.array([hashlib.sha256(s.encode()).hexdigest() for s in decoded], pa.string())]


FULL, DIGESTS = "piece_ids array<int>, decoded string", "n_tokens long, ids_sha256 string, decoded_sha256 string"


def transcode(docs: DataFrame, model_path: str, emit: Callable[[list[list[int]], list[str]], list[pa.Array]] = full, columns: str = FULL) -> DataFrame:
    """doc_id and what ``emit`` makes of ids and decoded texts (by default both, whole) of ``docs(doc_id, text)``."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        v = vocabulary(model_path)
        ids = v.encode(texts)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *emit(ids, v.library.decode(ids, num_threads=1))], names)

    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), kernel, f"doc_id {kind}, {columns}")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return transcode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), digests, DIGESTS)
