"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Texts are tokenised by the given vocabulary file, an end id closes each document.
Whole windows are cut off documents; what remains of them are pieces.  Runs of pieces
whose lengths add up to a whole number of windows are partitioned by multiway
differencing: partial partitions with opposing imbalances are merged until one with
near-equal windows is left.  Ids above a window's capacity are cut off and go to
windows with room; the window count rises whenever room is lacking.  Runs are made
within a task, as its rows stream by: nothing is shuffled, and a task holds one run.

Tokenising is vectorised: words are split by their code points' classes with numpy, and
only words not seen before by a worker go through the tokenizer.

A null or empty text is the end id alone.  Repeated rows are packed each by itself.
An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bound_batches, lean
from quire.llm.text import buffers, prefix_hashes, ranges, slices, span_hashes


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---- tokenising --------------------------------------------------------------------------

_OTHER, _LETTER, _NUMBER, _SPACE, _UNSURE = 0, 1, 2, 3, 4
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


#: A word without white space, but for one space before it.
_JOINABLE = re.compile(f" ?[^{''.join(map(chr, _SPACES))}]+\\Z")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point; _UNSURE where versions of Unicode could differ."""
    out = np.full(0x110000, _UNSURE, np.uint8)
    old = unicodedata.ucd_3_2_0.category
    for c in range(0x30000):
        ch = chr(c)
        now = unicodedata.category(ch)
        if now[0] == old(ch)[0] and now != "Cs" and now != "Cn":
            out[c] = _LETTER if now[0] == "L" else _NUMBER if now[0] == "N" else _OTHER
    out[_SPACES] = _SPACE
    return out


def split_words(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens, for texts of code points that begin at `bounds[:-1]`.

    Vectorised form of the byte-level BPE pattern: contractions, runs of letters,
    numbers or other signs with one space before, and white space.
    """
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    fresh = np.zeros(n + 1, bool)
    fresh[bounds] = True
    start |= fresh
    space = kind == _SPACE
    # last character of a run of white space that a word of the same text follows
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~fresh[1:n])
    start[last] = True
    start[last + 1] = points[last] != 32
    # contractions: a lone apostrophe, not joined to a space, before letters
    quote = np.flatnonzero((points[:-1] == 39) & start[: n - 1] & start[1:n] & (kind[1:] == _LETTER) & ~fresh[1:n])
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        a, b = padded[quote + 1], padded[quote + 2]
        same = ~fresh[np.minimum(quote + 2, n)] & (quote + 2 < n)
        one = np.isin(a, [115, 116, 109, 100])
        two = same & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
        length = np.where(one, 1, np.where(two, 2, 0))
        quote, length = quote[length > 0], length[length > 0]
        start[quote + 1] = False
        after = quote + 1 + length
        start[after] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Ids of texts; remembers the ids of the words it has seen, up to a bound."""

    def __init__(self, path: str, remember: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.remember = remember
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())], np.int64)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Words are encoded many at a time, with a line break before each: it splits off by
        itself, and ids are told apart by the bytes they stand for."""
        plain = np.array([_JOINABLE.match(t) is not None for t in texts])
        ids, count = [], np.zeros(len(texts), np.int64)
        joined = np.flatnonzero(plain)
        for group in np.array_split(joined, max(1, len(joined) // 400)):
            if not len(group):
                continue
            words = [texts[i] for i in group.tolist()]
            got = np.array(self.tokenizer.encode("\n" + "\n".join(words), add_special_tokens=False).ids, np.int32)
            ends = np.cumsum([len(w.encode("utf-8", "surrogatepass")) + 1 for w in words])
            stop = np.searchsorted(np.cumsum(self.bytes_of[got]), ends) + 1
            count[group] = np.diff(stop, prepend=0) - 1
            keep = np.ones(len(got), bool)
            keep[np.concatenate([[0], stop[:-1]])] = False
            ids.append(got[keep])
        alone = np.flatnonzero(~plain)
        for i, e in zip(alone.tolist(), self.tokenizer.encode_batch([texts[i] for i in alone.tolist()], add_special_tokens=False)):
            ids.append(np.array(e.ids, np.int32))
            count[i] = len(e.ids)
        order = np.concatenate([joined, alone])
        count = count[order]
        begin = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, *ids])
        all_keys = np.concatenate([self.keys, keys[order]])
        order = np.argsort(all_keys, kind="stable")
        self.keys, self.begin, self.count = all_keys[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.count, count])[order]

    def encode(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): ids[bounds[i]:bounds[i + 1]] are those of text i."""
        n = len(offsets) - 1
        if not len(body):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        raw = body.tobytes()
        points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        heads = np.append(np.flatnonzero((body & 0xC0) != 0x80), len(body))
        bounds = np.searchsorted(heads, offsets)
        unsure = np.flatnonzero(_classes()[points] == _UNSURE)
        # so are texts with an added token, such as <|endoftext|>, that is one id as a whole
        marked = np.array([m.start() for a in self.added for m in re.finditer(re.escape(a), raw)], np.int64)
        odd = np.union1d(np.searchsorted(bounds, unsure, side="right") - 1, np.searchsorted(offsets, marked, side="right") - 1)
        starts = split_words(points, bounds)
        first, end = heads[starts], heads[np.append(starts[1:], len(points))]
        keys = span_hashes(prefix_hashes(body), first, end)
        distinct, sample, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.remember:
            self.clear()
        at = np.searchsorted(self.keys, distinct)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == distinct[known]
        if not known.all():
            new = sample[~known]
            self._learn(distinct[~known], [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(first[new].tolist(), end[new].tolist())])
            at = np.searchsorted(self.keys, distinct)
        begin, count = self.begin[at][inverse], self.count[at][inverse]
        ids = self.ids[np.repeat(begin, count) + ranges(count)]
        row = np.searchsorted(offsets, first, side="right") - 1
        sizes = np.bincount(row, weights=count, minlength=n).astype(np.int64)
        out = np.concatenate([[0], np.cumsum(sizes)])
        if not len(odd):
            return ids, out
        parts = np.split(ids, out[1:-1])
        whole = self.tokenizer.encode_batch([raw[offsets[i] : offsets[i + 1]].decode("utf-8", "surrogatepass") for i in odd.tolist()], add_special_tokens=False)
        for i, e in zip(odd.tolist(), whole):
            parts[i] = np.array(e.ids, np.int32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---- differencing ------------------------------------------------------------------------


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: item numbers of each of k windows with near-equal sums.

    Each partial partition holds k sums; the two with the largest imbalances are merged,
    the fullest windows of one with the emptiest of the other.
    """
    if k <= 1 or not sizes:
        return [list(range(len(sizes))), *([] for _ in range(k - 1))]
    heap: list[tuple[int, int, np.ndarray, list[list[int]]]] = []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[-1] = size
        heap.append((-size, i, sums, [[] for _ in range(k - 1)] + [[i]]))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, ma = heapq.heappop(heap)
        _, _, b, mb = heapq.heappop(heap)
        sums = a + b[::-1]
        merged = [x + y for x, y in zip(ma, reversed(mb))]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[0] - sums[-1]), tie, sums - sums[0], [merged[j] for j in order.tolist()]))
        tie += 1
    return heap[0][3]


Piece = tuple[int, int, int]  # document (number in the task), start, length


def fill(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Windows of at most `capacity` ids; ids above it are cut off and fill windows with room."""
    k = -(-sum(p[2] for p in pieces) // capacity)
    windows = [[pieces[i] for i in w] for w in differencing([p[2] for p in pieces], k)]
    spare: list[Piece] = []
    room: list[tuple[int, int]] = []
    for i, w in enumerate(windows):
        load = sum(p[2] for p in w)
        while load > capacity:
            doc, start, length = w.pop()
            cut = min(length, load - capacity)
            if cut < length:
                w.append((doc, start, length - cut))
            spare.append((doc, start + length - cut, cut))
            load -= cut
        if load < capacity:
            room.append((i, capacity - load))
    for doc, start, length in spare:
        while length:
            if not room:
                windows.append([])
                room.append((len(windows) - 1, capacity))
            i, free = room.pop()
            take = min(free, length)
            windows[i].append((doc, start, take))
            start, length, free = start + take, length - take, free - take
            if free:
                room.append((i, free))
    return [w for w in windows if w]


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, windows: int = 64, end_id: int = 1, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    `windows`: windows that are filled together.  Only a task's last window may have
    room left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        held: dict[int, tuple[int | None, np.ndarray]] = {}
        waiting: list[Piece] = []
        total, number = 0, 0
        goal = windows * capacity
        rows: list[tuple] = []

        def emit(filled: list[list[Piece]]) -> None:
            nonlocal sequence
            for w in filled:
                at = 0
                for doc, start, length in w:
                    key, ids = held[doc]
                    part = ids[start : start + length]
                    rows.append((key, start, length, zlib.crc32(part.astype("<u4").tobytes()), len(ids), sequence, at, part if with_ids else None))
                    at += length
                sequence += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows))
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in OUT.split(", ")])
            rows.clear()
            return out

        for part in slices(batches, "text", 1 << 18):
            ids, bounds = enc.encode(*buffers(part.column(1)))
            for i, key in enumerate(part.column(0).to_pylist()):
                own = np.append(ids[bounds[i] : bounds[i + 1]], np.int32(end_id))
                held[number] = (key, own)
                whole = len(own) // capacity
                emit([[(number, j * capacity, capacity)] for j in range(whole)])
                rest = len(own) - whole * capacity
                if rest:
                    waiting.append((number, whole * capacity, rest))
                    total += rest
                    if total >= goal:  # the last piece is cut so that the windows are exactly full
                        over = total - goal
                        doc, start, length = waiting.pop()
                        waiting.append((doc, start, length - over))
                        emit(fill(waiting, capacity))
                        waiting = [(doc, start + length - over, over)] if over else []
                        total = over
                        held = {number: held[number]} if over else {}
                else:
                    del held[number]
                number += 1
            if rows:
                yield batch()
        if waiting:
            # full windows by differencing; what is left over makes the task's last one
            last, left = [], total % capacity
            while left and waiting:
                doc, start, length = waiting.pop()
                cut = min(left, length)
                last.append((doc, start + length - cut, cut))
                if cut < length:
                    waiting.append((doc, start, length - cut))
                left -= cut
            emit([*(fill(waiting, capacity) if waiting else []), *([last] if last else [])])
            yield batch()

    bound_batches(docs.sparkSession)
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(lean(run), OUT)
    return out if with_ids else out.drop("ids")
