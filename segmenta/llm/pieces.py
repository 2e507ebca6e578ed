"""SentencePiece encoding and decoding by suffix-array matching.

The text of a batch is cut where no piece of the vocabulary can cross (before white space that follows another
character, around characters that no piece joins to others), and its distinct chunks are laid end to end. A suffix
array over that text, sorted as deep as the longest piece, is searched for every piece at once (binary search on
piece prefixes); each hit of a piece's range is an edge from its first to its last character. Edges are sorted by
position and relaxed: in every chunk the edge of the best score that spans two adjacent symbols is taken, again and
again, which is the order in which a byte-pair model merges. Characters that no piece covers become byte pieces.

Chunks longer than LONG characters have few others to go in step with, so the same edges are relaxed from a heap there.

Defined cases: a null text has null ids, an empty text none; U+2581 in a text stands for a blank, as in the format, so decoding gives the blank; lone surrogates do not
occur in Spark strings; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmenta.llm.common import small_batches

VOCABULARY = os.environ.get("TOKENIZERS", "/opt/tokenizers") + "/piece_bpe_32k.model"
BLANK = "▁"
LONG = 64
#: Characters of distinct chunks that one suffix array indexes, and chunks whose ids a worker remembers.
INDEX_CHARS = 1 << 19
REMEMBERED = 1 << 20


class Vocabulary:
    """The pieces of a byte-pair SentencePiece model, as arrays."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        if proto.trainer_spec.model_type != 2 or proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a byte-pair model without normalisation is needed")
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.spelling = [b"" if p.type in (2, 3) else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.encode() for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
        self.scores = np.array([p.score for p in proto.pieces])
        # rank 0 is the best score; equal scores cannot meet, as scores of merges are distinct
        order = np.argsort(-self.scores, kind="stable")
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        joined = [p for p in self.ids if len(p) > 1]
        self.depth = max(map(len, joined), default=1)
        inner = {c for p in joined for c in p}
        after_blank = any(a != BLANK and b == BLANK for p in joined for a, b in zip(p, p[1:], strict=False))
        if after_blank:
            raise ValueError("pieces with a blank after other characters are not supported")
        # characters of the first plane that never join; white space of texts is the case that matters
        self.single = "".join(c for c in "\n\t\r\v\f" if c not in inner)
        s = re.escape(self.single)
        self.chunks = re.compile(f"[{s}]|{BLANK}*[^{BLANK}{s}]+|{BLANK}+" if s else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self._keys(joined)

    def _keys(self, joined: list[str]) -> None:
        joined.sort()
        self.sorted_ids = np.array([self.ids[p] for p in joined], np.int64)
        self.sorted_len = np.array([len(p) for p in joined], np.int64)
        self.table = np.zeros((len(joined), self.depth), np.uint32)
        for i, p in enumerate(joined):
            self.table[i, : len(p)] = np.frombuffer(p.encode("utf-32-le"), np.uint32)

    def normalised(self, text: str) -> str:
        return (BLANK if self.prefix else "") + text.replace(" ", BLANK) if text else ""

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8")]


def suffix_array(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `depth` characters, by prefix doubling, and each suffix's rank."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    n, k = len(codes), 1
    while k < depth:
        ahead = np.zeros(n, np.int64)
        ahead[: n - k] = rank[k:] + 1
        key = rank * (n + 2) + ahead
        order = np.argsort(key)
        step = np.empty(n, np.int64)
        step[0], step[1:] = 0, key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(step)
        k *= 2
    return np.argsort(rank), rank


def occurrence_ranges(codes: np.ndarray, order: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last place in the suffix array of the suffixes that begin with each piece: all pieces
    search at once, and compare character by character."""
    padded = np.concatenate([codes, np.zeros(v.depth, np.uint32)])
    m, n = len(v.sorted_ids), len(codes)

    def bound(right: bool) -> np.ndarray:
        low, high = np.zeros(m, np.int64), np.full(m, n, np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            begin = order[mid]
            less = np.full(len(open_), right)  # equal so far: goes right for the upper bound
            undecided = np.arange(len(open_))
            for c in range(v.depth):
                undecided = undecided[v.sorted_len[open_[undecided]] > c]
                if not undecided.size:
                    break
                a, b = padded[begin[undecided] + c], v.table[open_[undecided], c]
                less[undecided[a < b]], less[undecided[a > b]] = True, False
                undecided = undecided[a == b]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        return low

    return bound(False), bound(True)


def edges_of(codes: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of pieces of two characters or more, sorted by position: key begin * (depth + 1) + length,
    and piece."""
    order, _ = suffix_array(codes, v.depth)
    low, high = occurrence_ranges(codes, order, v)
    n = high - low
    piece = np.repeat(np.arange(len(n)), n)
    begin = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
    key = begin * (v.depth + 1) + v.sorted_len[piece]
    by = np.argsort(key)
    return key[by], v.sorted_ids[piece[by]]


def relax(codes: np.ndarray, chunk: np.ndarray, v: Vocabulary, long: int = LONG) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all chunks: begin, length, piece (-1: one character). In each round every chunk takes its best edge
    over two adjacent symbols, the leftmost of equal ones; chunks over `long` characters do so one after another."""
    keys, pieces = edges_of(codes, v)
    first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
    counts = np.diff(np.r_[first, len(chunk)])
    done = [relax_long(i, i + n, keys, pieces, v) for i, n in zip(first.tolist(), counts.tolist(), strict=True) if n > long]
    begin = np.flatnonzero(np.repeat(counts <= long, counts))
    size, piece, chunk = np.ones(len(begin), np.int64), np.full(len(begin), -1), chunk[begin]
    worst = np.iinfo(np.int64).max
    while len(begin):
        together = size[:-1] + size[1:]
        key = begin[:-1] * (v.depth + 1) + together
        at = np.searchsorted(keys, key)
        at[at == len(keys)] = 0
        fits = (chunk[:-1] == chunk[1:]) & (together <= v.depth)
        fits &= keys[at] == key if len(keys) else False
        found = np.where(fits, pieces[at], 0) if len(keys) else np.zeros(len(key), np.int64)
        cost = np.append(np.where(fits, v.rank[found], worst), worst)
        first = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        best = np.minimum.reduceat(cost, first)
        counts = np.diff(np.r_[first, len(chunk)])
        going = np.repeat(best < worst, counts)
        if not going.all():
            done.append((begin[~going], size[~going], piece[~going]))
        hit = going & (cost == np.repeat(best, counts))
        places = np.flatnonzero(hit)
        places = places[np.unique(chunk[places], return_index=True)[1]]  # leftmost in its chunk
        size[places] = together[places]
        piece[places] = found[places]
        going[places + 1] = False
        begin, size, piece, chunk = begin[going], size[going], piece[going], chunk[going]
    parts = [np.concatenate(x) for x in zip(*done, strict=True)]
    by = np.argsort(parts[0])
    return tuple(p[by] for p in parts)


def relax_long(start: int, stop: int, keys: np.ndarray, pieces: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of the one chunk from start to stop: its edges over adjacent symbols wait in a heap, best first, then
    leftmost."""
    width = v.depth + 1
    low, high = np.searchsorted(keys, [start * width, stop * width])
    keys, pieces = keys[low:high], pieces[low:high]
    n = stop - start
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    size, piece = np.ones(n, np.int64), np.full(n, -1)
    # edges over two characters are there from the beginning
    two = np.flatnonzero(keys % width == 2)
    heap = list(zip(v.rank[pieces[two]].tolist(), (keys[two] // width - start).tolist(), [2] * len(two), pieces[two].tolist(), strict=True))
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (total := int(size[i] + size[j])) <= v.depth:
            key = (start + i) * width + total
            k = int(np.searchsorted(keys, key))
            if k < len(keys) and keys[k] == key:
                heapq.heappush(heap, (int(v.rank[pieces[k]]), i, total, int(pieces[k])))

    while heap:
        _, i, total, found = heapq.heappop(heap)
        j = after[i] if size[i] else n
        if j >= n or not size[j] or size[i] + size[j] != total:
            continue
        size[i], size[j], piece[i] = total, 0, found
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(int(before[i]))
    alive = np.flatnonzero(size)
    return alive + start, size[alive], piece[alive]


class Encoder:
    """Encodes batches; remembers the ids of chunks, up to a bound."""

    def __init__(self, model: bytes):
        self.v = Vocabulary(model)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.begin = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        self.used = 0

    def _learn(self, new: list[str]) -> None:
        """ids of new chunks go to the end of the flat store."""
        self._store(new, self._ids("".join(new), np.fromiter(map(len, new), np.int64, len(new))))

    def _store(self, chunks: list[str], found: tuple[np.ndarray, np.ndarray]) -> None:
        ids, n = found
        at = len(self.place)
        self.place.update(zip(chunks, range(at, at + len(chunks)), strict=True))
        self.flat.append(ids.astype(np.int32))
        self.begin.append(self.used + np.cumsum(n))
        self.used += len(ids)

    def _ids(self, text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = self.v
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        begin, size, piece = relax(codes, np.repeat(np.arange(len(lengths)), lengths), v)
        chunk = np.searchsorted(np.cumsum(lengths), begin, "right")
        single = np.flatnonzero(piece < 0)
        chars, of = np.unique(codes[begin[single]], return_inverse=True)
        known = np.array([v.ids.get(chr(c), -1) for c in chars.tolist()], np.int64)
        if len(chars):
            piece[single] = known[of]
        width = np.ones(len(piece), np.int64)
        missing = np.flatnonzero(piece < 0)
        spelled = {c: v.bytes_of(chr(c)) for c in np.unique(codes[begin[missing]]).tolist()}
        tails = [spelled[c] for c in codes[begin[missing]].tolist()]
        width[missing] = [len(t) for t in tails]
        ids = np.repeat(piece, width)
        ends = np.cumsum(width)
        for k, t in zip(missing.tolist(), tails, strict=True):
            ids[ends[k] - len(t) : ends[k]] = t
        return ids, np.bincount(chunk, weights=width, minlength=len(lengths)).astype(np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """ids of each text."""
        v = self.v
        cut = [v.chunks.findall(v.normalised(t)) if t else [] for t in texts]
        k = 0
        out: list[np.ndarray | None] = []
        while k < len(texts):
            # as many texts as bring INDEX_CHARS of chunks not known yet
            if len(self.place) > REMEMBERED or self.used > 8 * REMEMBERED:
                self._forget()
            new: dict[str, None] = {}
            chars, last = 0, k
            while last < len(texts) and (last == k or chars < INDEX_CHARS):
                for c in cut[last]:
                    if c not in self.place and c not in new:
                        new[c] = None
                        chars += len(c)
                last += 1
            if new:
                for part in _portions(list(new)):
                    self._learn(part)
                self.flat, self.begin = [np.concatenate(self.flat)], [np.concatenate(self.begin)]
            flat, begin = self.flat[0], self.begin[0]
            for t in range(k, last):
                if texts[t] is None:
                    out.append(None)
                    continue
                at = np.fromiter(map(self.place.__getitem__, cut[t]), np.int64, len(cut[t]))
                n = begin[at + 1] - begin[at]
                out.append(flat[np.repeat(begin[at] - np.cumsum(n) + n, n) + np.arange(n.sum())])
            k = last
        return out

    def decode(self, ids: np.ndarray | None) -> str | None:
        """The text of ids: pieces joined, byte pieces as UTF-8, blanks restored, the added first blank removed."""
        if ids is None:
            return None
        v = self.v
        text = b"".join(map(v.spelling.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if v.prefix and text.startswith(" ") else text


def _portions(chunks: list[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for c in chunks:
        part.append(c)
        chars += len(c)
        if chars >= INDEX_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


_encoders: dict[str, Encoder] = {}


def _model(docs: DataFrame, vocabulary: str) -> tuple:
    """A name and the broadcast file."""
    with open(vocabulary, "rb") as f:
        data = f.read()
    return hashlib.sha256(data).hexdigest(), docs.sparkSession.sparkContext.broadcast(data)


def _encoder(model: tuple) -> Encoder:
    """One for each worker and model, so that what it remembers lasts from batch to batch."""
    if model[0] not in _encoders:
        _encoders[model[0]] = Encoder(model[1].value)
    return _encoders[model[0]]


def encoded(text: Column, docs: DataFrame, vocabulary: str = VOCABULARY) -> Column:
    """array<int> of ids."""
    model = _model(docs, vocabulary)

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(_encoder(model).encode(texts.tolist()))

    return encode(text)


def decoded(ids: Column, docs: DataFrame, vocabulary: str = VOCABULARY) -> Column:
    model = _model(docs, vocabulary)

    @F.pandas_udf("string")
    def decode(arrays: pd.Series) -> pd.Series:
        own = _encoder(model)
        return pd.Series([own.decode(None if a is None else np.asarray(a)) for a in arrays], dtype=object)

    return decode(ids)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding the ids gives the text back (blanks for U+2581)."""
    small_batches(docs.sparkSession, 1024)  # more chunks for one index
    model = _model(docs, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _encoder(model)
        for b in batches:
            texts = b["text"].tolist()
            ids = own.encode(texts)
            same = [t is None or own.decode(i) == t.replace(BLANK, " ") for t, i in zip(texts, ids, strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [0 if i is None else len(i) for i in ids], "ids": ids, "round_trip": same}).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id bigint, n_tokens bigint, ids array<int>, round_trip boolean")
