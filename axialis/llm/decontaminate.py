"""Benchmark decontamination by SimHash of item-sized windows.

Windows of words are compared by 64-bit SimHash, on a multi-index that finds every pair within RADIUS = 7: the
fingerprint is cut into four blocks of 16 bits, and of at most seven differing bits some block has at most one, so
looking up each block among the items' blocks and their 16 one-bit neighbours misses none.

An item of n words is represented by item-sized windows, at its start and at its end, of the largest size that
leaves room for STRIDE shifts (128 words at most), each at all shifts; a text's windows of that size start at every
multiple of STRIDE, so some pair of them holds the same words wherever the item starts. Changes can still move more than seven
bits, so windows of the item's pieces complete them. Of the m = n - 4 shingles, a similarity of 0.8 lets at most
m / 5 be lost at the item's ends, and m / 36 changes be made between: a change costs at least four shingles of the
item and adds four to the text, while (both's shingles - shared) is at most a quarter of the shared ones. What the ends can't
lose is cut into m // 36 + 1 pieces, so one piece is always unchanged, and its window is found with no bit differing.
Pieces of under 11 words, of short items, are searched at every word of a text (stride 1) at their full size.
(Items that repeat their own shingles in another order aren't covered by this count.)

A candidate is verified exactly: the weighted Jaccard similarity (multisets) of five-word shingles between the item
and the item-sized windows of the text (a shorter text: the whole of it) that start up to an item's length from where the
fingerprint puts it, at least 0.8. An item of under five words has one shorter shingle, so it
matches texts of the same words only, and isn't searched inside longer texts.

The items' index travels with the tasks while the benchmark has at most ITEMS_A_PASS items and PASS_BYTES of text; a
larger benchmark is taken in passes of that size, each over all texts and with its matches written to the shared
folder, so a job holds one pass's items and no pair is left out.

Defined cases: null and empty texts and items match nothing; repeated rows match alike, one row for each item;
null doc_ids are kept; ids may be of any type.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import WORDS_SQL, filter_texts, mix64, shingle_hashes, stored, text_chunks, word_hashes

STRIDE = 4
SIZES = {STRIDE: (8, 12, 16, 20, 24, 32, 48, 64, 96, 128), 1: (5, 6, 7, 8, 10)}
RADIUS = 7
SHINGLE = 5
ITEMS_A_PASS = 20_000
PASS_BYTES = 32 << 20
BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def prefix_votes(words: np.ndarray, stride: int = 1) -> np.ndarray:
    """Running sums of each bit's votes at every `stride` words; a whole number of strides.

    They wrap at 16 bits, which differences of less than 2**15 don't notice."""
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    parts = bits[0::stride].copy()
    for k in range(1, stride):
        parts += bits[k::stride]
    out = np.zeros((len(parts) + 1, 64), np.int16)
    np.cumsum(parts, axis=0, dtype=np.int16, out=out[1:])
    return out


def simhashes(votes: np.ndarray, starts: np.ndarray, size: int, stride: int = 1) -> np.ndarray:
    """Fingerprints of the windows of `size` words that start at `starts`, in strides."""
    more = votes[starts + size // stride] - votes[starts] > size // 2
    return np.packbits(more, axis=1, bitorder="little").view("<u8").reshape(-1)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class BlockIndex:
    """Fingerprints by each 16-bit block and its one-bit neighbours."""

    def __init__(self, prints: np.ndarray, owner: np.ndarray, shift: np.ndarray):
        self.prints, self.owner, self.shift = prints, owner, shift
        flips = np.concatenate([[0], 1 << np.arange(16)])
        self.blocks = []
        for k in range(4):
            block = (prints >> np.uint64(16 * k)).astype(np.int64) & 0xFFFF
            keys = (block[:, None] ^ flips).reshape(-1)
            order = np.argsort(keys, kind="stable")
            bounds = np.searchsorted(keys[order], np.arange((1 << 16) + 1)).astype(np.int32)
            self.blocks.append((bounds, (order // 17).astype(np.int32)))

    def near(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in `prints`, place in the index) within the radius, each once."""
        found = []
        for k, (bounds, own) in enumerate(self.blocks):
            block = (prints >> np.uint64(16 * k)).astype(np.int64) & 0xFFFF
            n = bounds[block + 1] - bounds[block]
            hit = np.flatnonzero(n)
            n = n[hit]
            left = np.repeat(hit, n)
            right = own[np.repeat(bounds[block[hit]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            close = distance(prints[left], self.prints[right]) <= radius
            found.append(left[close] * len(self.prints) + right[close])
        both = np.unique(np.concatenate(found))
        return both // len(self.prints), both % len(self.prints)


def item_windows(n: int) -> list[tuple[int, int, int]]:
    """(stride, size, first word) of the windows that represent an item of n words, n from 5 on."""
    out = set()
    if size := max((c for c in SIZES[STRIDE] if c + STRIDE - 1 <= n), default=0):
        out |= {(STRIDE, size, 0), (STRIDE, size, n - size - STRIDE + 1)}
    shingles = n - SHINGLE + 1
    edge, pieces = shingles // 5, shingles // 36 + 1
    piece = (n - 2 * edge) // pieces
    stride = STRIDE if piece >= min(SIZES[STRIDE]) + STRIDE - 1 else 1
    size = max(c for c in SIZES[stride] if c + stride - 1 <= piece)
    return sorted(out | {(stride, size, edge + k * piece) for k in range(pieces)})


class Items:
    """One pass's items, ready for search."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        words, bounds = word_hashes(texts)
        words = mix64(words)
        self.size = np.diff(bounds)
        shingles, ends = shingle_hashes(words, bounds, SHINGLE)
        self.shingles = [np.sort(shingles[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        grouped: dict[tuple[int, int], list] = {}
        self.short: dict[int, list[int]] = {}
        for i, n in enumerate(self.size.tolist()):
            if n >= SHINGLE:
                votes = prefix_votes(words[bounds[i] : bounds[i + 1]])
                for stride, size, first in item_windows(n):
                    shifts = first + np.arange(stride)
                    grouped.setdefault((stride, size), []).append((np.full(stride, i), shifts, simhashes(votes, shifts, size)))
            elif n:
                self.short.setdefault(int(shingles[ends[i]]), []).append(i)
        self.index = {}
        for key, rows in sorted(grouped.items()):
            owner, shift, prints = (np.concatenate(x) for x in zip(*rows, strict=True))
            self.index[key] = BlockIndex(prints, owner, shift)

    def search(self, words: np.ndarray, bounds: np.ndarray, radius: int) -> dict[int, set[tuple[int, int]]]:
        """Candidates of each text: (item, start of its window in the text)."""
        out: dict[int, set] = {}

        def put(text, item, start):
            for t, i, s in zip(text.tolist(), item.tolist(), start.tolist(), strict=True):
                out.setdefault(t, set()).add((i, s))

        n = np.diff(bounds)
        for stride in dict.fromkeys(s for s, _ in self.index):
            strides = -(-n // stride)
            first = np.concatenate([[0], np.cumsum(strides)])
            even = np.zeros(first[-1] * stride, np.uint64)
            even[np.arange(len(words)) + np.repeat(first[:-1] * stride - bounds[:-1], n)] = words
            votes = prefix_votes(even, stride)
            text = np.repeat(np.arange(len(n)), strides)
            inside = np.arange(first[-1]) - first[text]
            left = n[text] - inside * stride
            for (own, size), index in self.index.items():
                if own == stride and len(starts := np.flatnonzero(left >= size)):
                    at, found = index.near(simhashes(votes, starts, size, stride), radius)
                    at = starts[at]
                    put(text[at], index.owner[found], inside[at] * stride - index.shift[found])
        if self.short:
            texts = np.flatnonzero((n > 0) & (n < SHINGLE))
            shingles, ends = shingle_hashes(words, bounds, SHINGLE)
            for t in texts.tolist():
                for i in self.short.get(int(shingles[ends[t]]), ()):
                    out.setdefault(t, set()).add((i, 0))
        return out


def overlaps(item: np.ndarray, shingles: np.ndarray, width: int) -> np.ndarray:
    """The overlap of a sorted multiset with each window of `width` shingles of a text, windows in order.

    A text's shingle adds to the windows that hold it, but not as many of the same before it as the item has."""
    keys, most = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
    place = np.flatnonzero(keys[at] == shingles)
    place = place[np.argsort(at[place], kind="stable")]
    key, turn = at[place], np.arange(len(place))
    back = turn - most[key]
    same = (back >= 0) & (key[back] == key)
    windows = max(1, len(shingles) - width + 1)
    low = np.maximum(place - width + 1, 0)
    low[same] = np.maximum(low[same], place[back[same]] + 1)
    high = np.minimum(place, windows - 1) + 1
    some = low < high
    steps = np.bincount(low[some], minlength=windows + 1) - np.bincount(high[some], minlength=windows + 1)
    low_words = np.cumsum(steps[:windows])
    sizes = len(item) + min(width, len(shingles)) - low_words
    return low_words / sizes


def ranges(starts: list[int], reach: int, last: int):
    """The starts and `reach` to either side of each, held in 0..last, as ascending disjoint (first, last)."""
    out: list[list[int]] = []
    for s in sorted(starts):
        lo, hi = min(max(s - reach, 0), last), min(max(s + reach, 0), last)
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(hi, out[-1][1])
        else:
            out.append([lo, hi])
    return out


def hits(items: Items, texts: list[str], radius: int, least: float) -> dict[int, list[tuple[int, float, int, int]]]:
    """Of each text that holds one: (item, best similarity, its start in words, windows that are similar enough)."""
    words, bounds = word_hashes(texts)
    words = mix64(words)
    out = {}
    for text, found in items.search(words, bounds, radius).items():
        own = words[bounds[text] : bounds[text + 1]]
        shingles, _ = shingle_hashes(own, np.array([0, len(own)]), SHINGLE)
        places: dict[int, list[int]] = {}
        for item, start in found:
            places.setdefault(item, []).append(start)
        good = []
        for item, starts in sorted(places.items()):
            n = int(items.size[item])
            width = max(1, n - SHINGLE + 1)
            best, at, count = 0.0, 0, 0
            for lo, hi in ranges(starts, n, max(0, len(shingles) - width)):
                similar = overlaps(items.shingles[item], shingles[lo : hi + width], width)
                count += int((similar >= least).sum())
                if similar.max() > best:
                    best, at = float(similar.max()), lo + int(similar.argmax())
            if count:
                good.append((item, best, at, count))
        if good:
            out[text] = good
    return out


def _passes(benchmark: DataFrame, size: int):
    """Items in id order, at most `size` of them and about PASS_BYTES at a time on the driver."""
    ids, texts, used = [], [], 0
    rows = benchmark.select("item_id", "text").where("text is not null").distinct()
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        used += len(row[1])
        if len(ids) == size or used >= PASS_BYTES:
            yield ids, texts
            ids, texts, used = [], [], 0
    if ids:
        yield ids, texts


def contamination(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, least: float = 0.8, items_a_pass: int = ITEMS_A_PASS, key: str = "doc_id") -> DataFrame:
    """key, item_id, similarity, at_word, n_windows: one row for each text and each item it holds."""
    kind = benchmark.schema["item_id"].dataType
    names = [("item_id", kind), ("similarity", T.DoubleType()), ("at_word", T.LongType()), ("n_windows", T.LongType())]
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)] + [T.StructField(n, k) for n, k in names])
    arrow = [to_arrow_type(k) for _, k in names]

    def matches(ids, texts):
        def run(batches):
            items = Items(ids, texts)
            for batch in text_chunks(batches, limit=1 << 20):
                at, rows = [], []
                for i, got in sorted(hits(items, batch.column(1).to_pylist(), radius, least).items()):
                    at += [i] * len(got)
                    rows += [(ids[x[0]], *x[1:]) for x in got]
                columns = zip(*rows, strict=True) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *[pa.array(c, k) for c, k in zip(columns, arrow, strict=True)]], schema.names)

        return docs.select(key, "text").mapInArrow(run, schema)

    out, waiting = None, None
    for own in _passes(benchmark, items_a_pass):
        if waiting:
            part = stored(matches(*waiting), "matches")
            out = part if out is None else out.unionByName(part)
        waiting = own
    if not waiting:
        return docs.sparkSession.createDataFrame([], schema)
    last = matches(*waiting)
    return last if out is None else out.unionByName(last)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, least: float = 0.8, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """The rows that hold no item, all columns; each pass filters what the one before kept."""
    waiting = None
    for own in _passes(benchmark, items_a_pass):
        if waiting:
            docs = stored(_without(docs, *waiting, radius, least), "clean")
        waiting = own
    return _without(docs, *waiting, radius, least) if waiting else docs


def _without(docs: DataFrame, ids: list, texts: list[str], radius: int, least: float) -> DataFrame:
    def make():
        items = Items(ids, texts)

        def judge(own: list[str]) -> list[bool]:
            found = hits(items, own, radius, least)
            return [i not in found for i in range(len(own))]

        return judge

    return filter_texts(docs, make, 1 << 20)


# Every item-sized window that has a shingle of an item, by counting.
CONTAMINATION_SQL = f"""
WITH b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT item_id, len(w) - 4 AS width, sh, count(*) AS n FROM (SELECT item_id, w, array_to_string(w[k : k + 4], ' ') AS sh FROM (SELECT *, unnest(range(1, len(w) - 3)) AS k FROM b WHERE len(w) >= 5)) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS_SQL} AS w FROM documents),
s AS (SELECT rid, len(w) - 4 AS total, k - 1 AS pos, array_to_string(w[k : k + 4], ' ') AS sh FROM (SELECT *, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)),
h AS (SELECT s.rid, i.item_id, total, width, pos, sh, n FROM s JOIN i USING (sh)),
f AS (SELECT h.* FROM h JOIN (SELECT rid, item_id FROM h GROUP BY ALL HAVING count(*) >= 0.4 * least(any_value(width), any_value(total))) USING (rid, item_id)),
x AS (SELECT rid, item_id, width, total, n, sh, unnest(range(greatest(0, pos - width + 1), least(pos, greatest(0, total - width)) + 1)) AS p FROM f),
o AS (SELECT rid, item_id, width, total, p, sum(low) AS low FROM (SELECT rid, item_id, width, total, p, least(count(*), any_value(n)) AS low FROM x GROUP BY rid, item_id, width, total, p, sh) GROUP BY ALL),
z AS (SELECT rid, item_id, p, low / (width + least(width, total) - low)::DOUBLE AS similarity FROM o)
SELECT d.doc_id, item_id, round(max(similarity), 9) AS similarity, arg_min(p, (-similarity, p)) AS at_word, count(*) AS n_windows FROM z JOIN d USING (rid) WHERE similarity >= 0.8 GROUP BY rid, d.doc_id, item_id
"""
