"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte covered by a string of `length` bytes that also starts anywhere else, in the same text or another, goes.

The corpus is dealt to blocks so that equal strings always meet. In each window of `length` bytes the k-mer of
least hash, the leftmost of equals, is its anchor; it depends on the window's content alone. Neighbouring windows
with one anchor form a run, and the run's bytes are a span. Only spans whose anchor occurs at least twice go on,
equal spans are collapsed with their number first, and spans of one anchor go to one block.

In a block the distinct spans are joined, the suffix array is built by prefix doubling, and the transform is
searched breadth-first: an interval of suffixes that begin with w is extended backwards by each character c in
it, giving the interval of cw; if no common prefix is known yet at that interval's right end, it is len(w), and
the interval is searched further. So common prefixes appear in increasing order, and the search stops at `length`:
ends still open have a common prefix of at least that. The search begins with the intervals of seven characters,
which the first sorting step already has.

An anchor with more than HOT distinct spans (a very common passage in changing surroundings) would make one block
too large. Its spans are cut anew at a second, narrower anchor: windows whose k-mer lies at one of `width` neighbouring offsets
hold the same core of length + 1 - width bytes around it, so pieces of those windows are grouped by offset and core, and
equal windows still meet. Groups that are too large again are cut by the next of WIDTHS; at a width of 1 a group has
one distinct window, so every group ends in a block or as copies of one piece.

Rows of the most common keys (over a thousandth of all rows, so at most a thousand keys) are spread by salts.

Defined cases: null texts are empty; texts shorter than `length` keep all; a text of at least `length` bytes that
occurs twice loses all its bytes (it is searched once, as one text); very long texts are anchored in overlapping
pieces; null and repeated doc_ids each give their own row.
"""

from __future__ import annotations

import hashlib
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, discard, mix64, salted_join, skew_join, stored, text_chunks, top_keys

LENGTH = 200
KMER = 40
HOT = 1500
WIDTHS = (40, 8, 1)
BLOCK = 1 << 19
PIECE = 1 << 20
TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def kmer_hashes(data: np.ndarray, k: int = KMER) -> np.ndarray:
    """Hashes of all runs of k bytes, composed of runs of powers of two."""
    power, size, out, have = TABLE[data], 1, None, 0
    step = 0
    while True:
        if k & size:
            out = power if out is None else out[: len(power) - have] * ODD[step % 6] + power[have:]
            have += size
        if have == k:
            return mix64(out)
        power = power[:-size] * ODD[step % 6] + power[size:] if len(power) > size else power[:0]
        size, step = 2 * size, step + 1
        if out is not None:
            out = out[: max(0, len(data) - k + 1) + k - have]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each run; `ends` are the texts' ends in `data`."""
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = kmer_hashes(data, k)
    keys = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (sliding_min(keys, length - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.ones(len(anchor), bool)
    for end in ends[:-1]:
        valid[max(0, end - length + 1) : end] = False
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= (anchor[1:] != anchor[:-1]) | ~valid[1:]
    return hashes[anchor[first]], first, np.flatnonzero(stop) - first + 1


def suffix_array(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, ranks, and the keys of the first seven characters in its order. Characters are below 511."""
    n = len(s)
    padded = np.concatenate([s.astype(np.int64) + 1, np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key << 9 | padded[k : n + k]
    sa = np.argsort(key)
    head = key[sa]
    new = np.ones(n, bool)
    new[1:] = head[1:] != head[:-1]
    depth = 7
    rank = np.zeros(n + 1, np.int64)
    while True:
        at = np.flatnonzero(new)
        group = np.repeat(at, np.diff(np.append(at, n)))
        rank[:n][sa] = group + 1
        rank[n] = 0
        if len(at) == n:
            return sa, rank[:n] - 1, head
        tied = ~new
        tied[:-1] |= ~new[1:]
        where = np.flatnonzero(tied)
        own = sa[where]
        pair = group[where] * (n + 1) + rank[np.minimum(own + depth, n)]
        order = np.argsort(pair)
        sa[where], pair = own[order], pair[order]
        more = np.ones(len(where), bool)
        more[1:] = pair[1:] != pair[:-1]
        new[where] |= more
        depth *= 2


def shared_suffixes(s: np.ndarray, least: int) -> np.ndarray:
    """Whether the `least` characters from each place on start anywhere else too."""
    n = len(s)
    if n < 2:
        return np.zeros(n, bool)
    sa, rank, head = suffix_array(s)
    bwt = s[sa - 1].astype(np.int64)
    lf = rank[sa - 1]
    by_char = np.argsort(bwt.astype(np.uint16), kind="stable")
    sorted_keys = bwt[by_char] * n + by_char
    following = np.full(n, n, np.int64)
    same = bwt[by_char[1:]] == bwt[by_char[:-1]]
    following[by_char[:-1][same]] = by_char[1:][same]
    prefix = np.full(n + 1, -1, np.int16)
    prefix[0] = prefix[n] = 0
    differ = head[1:] ^ head[:-1]
    for k in range(7):
        part = (differ >> (9 * (6 - k))) != 0
        prefix[1:n][part & (prefix[1:n] < 0)] = k
    cuts = np.concatenate([[0], np.flatnonzero(differ) + 1, [n]])
    fresh = prefix[cuts[1:]] == 6
    lo, hi = cuts[:-1][fresh], cuts[1:][fresh]
    # the sort closes all the ends below seven characters; those of six are the first to search from
    if least <= 7:
        raise ValueError("the least length must be over 7")
    for depth in range(7, least):
        if not len(lo):
            break
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        last = following[at] >= np.repeat(hi, size)
        at, start = at[last], np.repeat(lo, size)[last]
        right = lf[at] + 1
        open_ = prefix[right] < 0
        at, start, right = at[open_], start[open_], right[open_]
        prefix[right] = depth
        lo = np.searchsorted(sorted_keys, bwt[at] * n + start)
        hi = right
    deep = prefix[1:n] < 0
    out = np.zeros(n, bool)
    out[sa[1:][deep]] = True
    out[sa[:-1][deep]] = True
    return out


def block_masks(spans: list[bytes], least: int = LENGTH) -> list[np.ndarray]:
    """For each span, which of its windows also start elsewhere in the block."""
    joined = np.frombuffer(b"\0".join(spans), np.uint8).astype(np.int64) + 1
    ends = np.cumsum([len(x) + 1 for x in spans])
    joined[ends[:-1] - 1] = 0
    shared = shared_suffixes(joined, least)
    return [shared[e - 1 - len(x) : e - least] for e, x in zip(ends, spans, strict=True)]


def _pieces(batch: pa.RecordBatch):
    """(ids, offsets, bytes and ends) of parts of a chunk; long texts in pieces that share length - 1 bytes."""
    short, long = [], []
    for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        data = text.encode()
        (short if len(data) <= PIECE else long).append((uid, 0, data))
    if short:
        yield short
    for uid, _, data in long:
        for at in range(0, len(data) - LENGTH + 1, PIECE):
            yield [(uid, at, data[at : at + PIECE + LENGTH - 1])]


def _anchors(batches):
    for batch in text_chunks(batches, limit=PIECE):
        for part in _pieces(batch):
            data = np.frombuffer(b"".join(x[2] for x in part), np.uint8)
            ends = np.cumsum([len(x[2]) for x in part])
            h, first, n = runs(data, ends)
            own = np.searchsorted(ends, first, side="right")
            base = np.array([x[1] for x in part], np.int64) - (ends - np.array([len(x[2]) for x in part]))
            uid = np.array([x[0] for x in part], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(uid[own]), pa.array(first + base[own]), pa.array(n.astype(np.int32))], ["h", "uid", "start", "n"])


def _spans(batches):
    for batch in text_chunks(batches, limit=1 << 20):
        out = []
        for uid, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = text.encode()
            for r in own:
                span = data[r["start"] : r["start"] + r["n"] - 1 + LENGTH]
                out.append((r["h"], hashlib.md5(span).digest(), span, uid, r["start"], r["n"]))
        for at in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 20_000], strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["h", "sp", "span", "uid", "start", "n"])


def _search(batches):
    """Masks of the spans of whole anchors, taken together up to BLOCK bytes. Rows come in order of h."""

    def rows():
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)

    def done(block):
        masks = block_masks([x[2] for x in block])
        hit = [(x[1], np.packbits(m).tobytes()) for x, m in zip(block, masks, strict=True) if m.any()]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in hit], pa.binary()), pa.array([x[1] for x in hit], pa.binary())], ["sp", "mask"])

    block, size = [], 0
    for _, group in groupby(rows(), itemgetter(0)):
        own = list(group)
        if len(own) > 1:
            block += own
            size += sum(len(x[2]) for x in own)
            if size >= BLOCK:
                yield done(block)
                block, size = [], 0
    if block:
        yield done(block)


def _cut(width: int):
    """Pieces of spans, of the windows whose anchor lies at one of `width` neighbouring offsets."""

    def pieces(root, i0, h, span, mult):
        p = int(np.argmin(kmer_hashes(np.frombuffer(span, np.uint8)) >> np.uint64(32)))
        n, at = len(span) - LENGTH + 1, 0
        while at < n:
            band = (p - at) // width
            to = min(n, p - band * width + 1)
            core = span[p - band * width : p - band * width - width + 1 + LENGTH]
            key = hashlib.md5(b"%d:%d:" % (h, band) + core).digest()[:8]
            piece = span[at : to - 1 + LENGTH]
            yield root, i0 + at, int.from_bytes(key, "little", signed=True), hashlib.md5(piece).digest(), piece, mult
            at = to

    def run(batches):
        kinds = (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
        for batch in byte_chunks(batches, (3,)):
            out = [x for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in pieces(*row)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["root", "i0", "h", "sp", "span", "mult"])

    return run


def _apply(batches):
    for batch in text_chunks(batches, limit=1 << 20):
        out = []
        for uid, text, marks in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data = np.frombuffer(text.encode(), np.uint8)
            edge = np.zeros(len(data) + 1, np.int64)
            for m in marks:
                n, start = m["n"], m["start"]
                if m["mask"] is None:
                    at = np.arange(start, start + n)
                elif len(m["mask"]) == -(-n // 8):
                    at = start + np.flatnonzero(np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=n))
                else:
                    raise ValueError("a mask of another length")
                edge[at] += 1
                np.subtract.at(edge, at + LENGTH, 1)
            gone = np.cumsum(edge[:-1]) > 0
            starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((uid, int(gone.sum()), starts, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["uid", "n_removed", "n_spans", "kept_sha256"])


def searched(distinct: DataFrame, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """From distinct spans (sp, h, span, mult): sp and mask (null: all) of those with shared windows, and the spans of
    the groups h with more than `hot` spans, which are left out."""
    per = stored(distinct.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "groups")
    grouped = skew_join(distinct, per, "h", top_keys(per, "h", "k", distinct.count()), "sp")
    blocks = grouped.where(F.col("k") <= hot).select("h", "sp", "span")
    n = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    found = blocks.repartition(n, "h").sortWithinPartitions("h", "sp").mapInArrow(_search, "sp binary, mask binary")
    whole = distinct.where("mult > 1").select("sp", F.lit(None).cast("binary").alias("mask"))
    masks = stored(found.join(whole.select("sp"), "sp", "left_anti").unionByName(whole), "masks")
    large = None
    if per.where(F.col("k") > hot).limit(1).count():
        large = stored(grouped.where(F.col("k") > hot).select("h", "sp", "span", "mult"), "large")
    discard(per)
    return masks, large


def span_masks(distinct: DataFrame, hot: int) -> tuple[DataFrame, list[DataFrame]]:
    """sp, i0, n, mask: which of the n windows of a span from i0 on also start elsewhere (null: all); and the stored
    frames that this reads."""
    size = (F.octet_length("span") - LENGTH + 1).alias("n")
    masks, large = searched(distinct, hot)
    used = [masks]
    out = masks.join(distinct.select("sp", size), "sp").select("sp", F.lit(0).alias("i0"), "n", "mask")
    rows = large.select(F.col("sp").alias("root"), F.lit(0).alias("i0"), "h", "span", "mult") if large else None
    for width in WIDTHS:
        if rows is None:
            break
        pieces = stored(rows.select("root", "i0", "h", "span", "mult").mapInArrow(_cut(width), "root binary, i0 int, h long, sp binary, span binary, mult long"), "pieces")
        same = stored(pieces.groupBy("sp").agg(F.first("h").alias("h"), F.first("span").alias("span"), F.sum("mult").alias("mult")), "distinct")
        if large:
            discard(large)
        masks, large = searched(same, hot)
        used += [masks, pieces, same]
        named = pieces.select("root", "i0", "sp", size)
        out = out.unionByName(salted_join(named, masks, "sp", "root").select(F.col("root").alias("sp"), "i0", "n", "mask"))
        rows = salted_join(pieces.select("root", "i0", "sp", "mult"), large.select("sp", "h", "span"), "sp", "root") if large else None
    return out, used


def repeated_bytes(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("th"), text.alias("text"))
    uniq = keyed.groupBy("th").agg(F.first("text").alias("text"), F.count("*").alias("m"))
    uniq = stored(uniq.withColumn("uid", F.monotonically_increasing_id()), "texts")
    long = uniq.where(F.octet_length("text") >= LENGTH)
    anchors = stored(long.select("uid", "text").mapInArrow(_anchors, "h long, uid long, start long, n int"), "anchors")
    again = stored(anchors.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "again")
    shared = skew_join(anchors, again.select("h"), "h", top_keys(again, "h", "k", anchors.count()), "uid")
    found = shared.groupBy("uid").agg(F.collect_list(F.struct("h", "start", "n")).alias("runs"))
    spans = long.select("uid", "text").join(found, "uid").select("uid", "text", "runs")
    spans = stored(spans.mapInArrow(_spans, "h long, sp binary, span binary, uid long, start long, n int"), "spans")
    discard(anchors, again)
    distinct = spans.groupBy("sp").agg(F.first("h").alias("h"), F.first("span").alias("span"), F.count("*").alias("mult"))
    distinct = stored(distinct, "distinct")
    masks, used = span_masks(distinct, hot)
    marks = skew_join(spans.select("sp", "uid", "start"), masks, "sp", top_keys(distinct, "sp", "mult", spans.count()), "uid")
    marks = marks.select("uid", (F.col("start") + F.col("i0")).alias("start"), "n", "mask")
    marks = marks.groupBy("uid").agg(F.collect_list(F.struct("start", "n", "mask")).alias("marks"))
    once = long.where("m = 1").select("uid", "text")
    cut = once.join(marks, "uid").select("uid", "text", "marks").mapInArrow(_apply, "uid long, n_removed long, n_spans long, kept_sha256 string")
    cut = stored(cut, "cut")
    discard(spans, distinct, *used)
    size = F.octet_length("text").cast("long")
    copied = (F.col("m") > 1) & (size >= LENGTH)
    kept = F.when(copied, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.sha2(F.col("text").cast("binary"), 256))
    plain = uniq.select("uid", "th", size.alias("n_bytes"), F.when(copied, size).otherwise(F.lit(0)).alias("all_gone"), copied.cast("long").alias("one_span"), kept.alias("kept"))
    out = plain.join(cut, "uid", "left").select("th", "n_bytes", F.coalesce("n_removed", "all_gone").cast("long").alias("n_removed"), F.coalesce("n_spans", "one_span").cast("long").alias("n_spans"), F.coalesce("kept_sha256", "kept").alias("kept_sha256"))
    return salted_join(keyed.select("doc_id", "th"), out, "th", "doc_id").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


# Every window of 200 bytes, as hexadecimal digits, by its MD5.
REPEATS_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT rid, s, md5(substr(x, 2 * s + 1, 400)) AS m FROM (SELECT rid, x, unnest(range(len(x) // 2 - 199)) AS s FROM d WHERE len(x) >= 400)),
t AS (SELECT rid, s FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
i AS (SELECT rid, s, sum(new) OVER (PARTITION BY rid ORDER BY s) AS run FROM (SELECT rid, s, CASE WHEN s <= lag(s) OVER (PARTITION BY rid ORDER BY s) + 200 THEN 0 ELSE 1 END AS new FROM t)),
p AS (SELECT rid, min(s) AS a, max(s) + 200 AS b FROM i GROUP BY rid, run),
q AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS since FROM p),
k AS (SELECT q.rid, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
      FROM q JOIN d ON d.rid = q.rid GROUP BY q.rid)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN k ON k.rid = d.rid
"""
