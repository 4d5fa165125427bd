"""Near-duplicate documents by ProbMinHash, banding and exact verification.

Shingles are runs of five lower-case words (a text of fewer words is one shingle), weighted by how often the text
has them. Each shingle is a Poisson process whose rate is its weight and whose points fall on SIGNATURE places at
random; a place keeps the shingle with the earliest point, so two texts agree on a place with the probability
Jaccard similarity of their weights. Points of a shingle are drawn in order of time and drawing ends early, once
the next point is later than the latest point kept.

Signatures are cut into BANDS bands of ROWS places; at a similarity of 0.8 all bands differ with a probability of
about (1 - 0.8**4)**25 = 2e-6. Equal texts are collapsed first, by MD5, so a group of copies is one row from
there on. In each bucket every text is compared with the most central one, so most texts of a group
meet. What is left are buckets that still hold two components, and links between those may be missing. For
all texts of such buckets the missing pairs are found exactly, by prefix filtering: with a text's shingles in
order of rarity, two texts of similarity 0.8 share one among the first fifth, at places that leave enough
shingles after them. Texts of one component need no more pairs, and a text of which over a fifth occurs nowhere
else has none, so a large group of copies doesn't come back as all its pairs. A link is a
weighted Jaccard similarity (of shingle multisets) of at least 0.8, computed from the texts. Components come from
min-label propagation with hooking of parents and pointer jumping, until no label changes, over tables written to
the shared folder; the rounds grow with the logarithm of a chain of links.

Defined cases: null texts are empty; texts without words only equal their exact copies; null doc_ids are kept and
come after all others; repeated rows are in one class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDS_SQL, byte_chunks, discard, few_stored, mix64, salted_join, shingle_hashes, skew_join, stored, text_chunks, top_keys, word_hashes

BANDS = 25
ROWS = 4
SIGNATURE = BANDS * ROWS
SHINGLE = 5
LEAST = 0.8


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def weighted(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, their text and their weight, texts in order."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.argsort(shingles)
    order = order[np.argsort(text[order], kind="stable")]
    s, t = shingles[order], text[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return s[at], t[at], np.diff(np.append(at, len(s)))


def signatures(shingles: np.ndarray, text: np.ndarray, weight: np.ndarray, texts: int, places: int = SIGNATURE) -> np.ndarray:
    """texts x places hashes; a text without shingles has zeros."""
    first = np.full(texts * places, np.inf)
    kept = np.zeros(texts * places, np.uint64)
    live, mixed = np.arange(len(shingles)), mix64(shingles)
    time = np.zeros(len(shingles))
    turn = 0
    while len(live):
        turn += 1
        noise = mix64(mixed[live] ^ mix64(np.array([turn], np.uint64)))
        time[live] -= np.log(((noise >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight[live]
        place = text[live] * places + (mix64(noise) % np.uint64(places)).astype(np.int64)
        np.minimum.at(first, place, time[live])
        won = first[place] == time[live]
        kept[place[won]] = shingles[live[won]]
        latest = first.reshape(texts, places).max(1)
        live = live[time[live] < latest[text[live]]]
    return kept.reshape(texts, places)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """texts x BANDS keys of 64 bits, the band's number mixed in."""
    out = np.zeros((len(signature), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(ROWS):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + signature[:, k::ROWS])
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted distinct shingles, weights)."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    low = np.minimum(a[1][at[same]], b[1][same]).sum()
    most = a[1].sum() + b[1].sum() - low
    return float(low / most) if most else 0.0


def _sign(batches):
    for batch in text_chunks(batches, limit=1 << 20):
        words, bounds = word_hashes(batch.column(1).to_pylist())
        shingles, ends = shingle_hashes(words, bounds, SHINGLE)
        keys = band_keys(signatures(*weighted(shingles, ends), batch.num_rows)).astype(np.int64)
        some = np.diff(ends) > 0
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32), keys[some].reshape(-1))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["th", "bands"])


def _verify(batches):
    for own in byte_chunks(batches, (2, 3), 2 << 20):
        texts = own.column(2).to_pylist() + own.column(3).to_pylist()
        distinct = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        words, bounds = word_hashes([t or "" for t in distinct])
        shingles, ends = shingle_hashes(words, bounds, SHINGLE)
        s, t, w = weighted(shingles, ends)
        at = np.searchsorted(t, np.arange(len(distinct) + 1))
        bag = [(s[a:b], w[a:b]) for a, b in zip(at, at[1:], strict=False)]
        n = own.num_rows
        found = [similarity(bag[distinct[texts[i]]], bag[distinct[texts[n + i]]]) for i in range(n)]
        yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, similarity of distinct pairs (a, b); `texts` has th and text. Any text may be in most pairs as b."""
    one = pairs.join(texts.select(F.col("th").alias("a"), F.col("text").alias("ta")), "a")
    two = salted_join(one, texts.select(F.col("th").alias("b"), F.col("text").alias("tb")), "b", "a")
    return two.select("a", "b", "ta", "tb").mapInArrow(_verify, "a binary, b binary, similarity double")


def _tokens(batches):
    for batch in text_chunks(batches, limit=1 << 20):
        words, bounds = word_hashes(batch.column(1).to_pylist())
        shingles, ends = shingle_hashes(words, bounds, SHINGLE)
        s, t, w = weighted(shingles, ends)
        turn = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        token = mix64(np.repeat(s, w) + turn.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).astype(np.int64)
        text = np.repeat(t, w)
        n = np.diff(ends)
        for at in range(0, len(token), 100_000):
            own = text[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(n[own].astype(np.int32)), pa.array(token[at : at + 100_000])], ["th", "n", "token"])


def prefix_pairs(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of `rest` (th, component) in different components that can have a similarity of 0.8.

    The n-th occurrence of a shingle is a token of its own, so overlaps of tokens are those of multisets; o shared
    ones of sizes p and q are similar enough if 9 o >= 4 (p + q)."""
    own = texts.join(rest, "th", "left_semi").select("th", "text")
    tokens = stored(own.mapInArrow(_tokens, "th binary, n int, token long"), "tokens")
    often = few_stored(tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1"), "often")
    known = skew_join(tokens, often, "token", top_keys(often, "token", "f", tokens.count()), "th")
    known = known.groupBy("th").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("f", "token"))).alias("t"))
    known = known.where("5 * size(t) >= 4 * n")
    placed = known.select("th", "n", F.posexplode("t").alias("i", "x"), (F.col("n") - F.size("t")).alias("alone"))
    placed = placed.select("th", "n", F.col("x.token").alias("token"), (F.col("i") + F.col("alone")).alias("pos")).where("5 * (n - pos) >= 4 * n")
    placed = stored(placed.join(rest, "th"), "prefixes")
    discard(tokens, often)
    p, q = placed.alias("p"), placed.alias("q")
    both = p.join(q, F.expr("p.token = q.token and p.component < q.component and 9 * least(p.n - p.pos, q.n - q.pos) >= 4 * (p.n + q.n)"))
    pairs = few_stored(both.select(F.col("p.th").alias("a"), F.col("q.th").alias("b")).distinct(), "pairs")
    discard(placed)
    return pairs


def components(links: DataFrame) -> DataFrame:
    """th, component of every text in a link: the least th of its component. Links are (a, b).

    Each round takes the least label among a text's neighbours, gives it to the text's parent too (hooking), and
    jumps over the parent. Labels only fall, and a round without a change leaves one label a component. A text of
    most links and a component of most texts are spread by salts."""
    edges = few_stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    label = few_stored(edges.groupBy(F.col("a").alias("th")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        far = salted_join(edges, label.select(F.col("th").alias("b"), "component"), "b", "a").groupBy(F.col("a").alias("th")).agg(F.min("component").alias("far"))
        step = few_stored(label.join(far, "th").select("th", F.col("component").alias("was"), F.least("component", "far").alias("low")), "steps")
        hooks = step.groupBy(F.col("was").alias("th")).agg(F.min("low").alias("hook"))
        hooked = few_stored(step.join(hooks, "th", "left").select("th", "was", F.least("low", "hook").alias("component")), "hooked")
        roots = hooked.select(F.col("th").alias("component"), F.col("component").alias("root"))
        new = few_stored(salted_join(hooked, roots, "component", "th").select("th", F.least("component", "root").alias("component"), "was"), "labels")
        discard(label, step, hooked)
        label = new
        if not new.where("component <> was").limit(1).count():
            discard(edges)
            return label


def near_classes(docs: DataFrame, described: bool = True) -> DataFrame:
    """th and component (the least th of those it is linked to) of each distinct text; described with class_texts,
    similarity, n_links and best."""
    rows = docs.select(text_key().alias("th"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    signed = rows.mapInArrow(_sign, "th binary, bands array<long>").groupBy("th").agg(F.first("bands").alias("bands"))
    signed = few_stored(signed, "signed")
    spread = signed.select("th", F.explode("bands").alias("key"))
    sizes = few_stored(spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    top = top_keys(sizes, "key", "n", BANDS * signed.count())
    members = few_stored(skew_join(spread, sizes, "key", top, "th"), "shared")
    # a bucket's head is its most central text, whose buckets hold the most texts: changed copies lie around it
    central = members.groupBy("th").agg(F.sum("n").alias("weight"))
    ranked = members.join(central, "th").select("key", "th", "weight")
    heads = few_stored(ranked.groupBy("key").agg(F.max(F.struct("weight", "th")).alias("m")).select("key", F.col("m.th").alias("head")), "heads")
    near = few_stored(skew_join(members.select("key", "th"), heads, "key", top, "th"), "members")
    discard(members, heads)
    wanted = near.select("th").distinct()
    texts = rows.groupBy("th").agg(F.first("text").alias("text")).join(wanted, "th", "left_semi")
    texts = stored(texts, "texts")
    tried = few_stored(verified(near.where("th <> head").select(F.col("th").alias("a"), F.col("head").alias("b")).distinct(), texts).where(F.col("similarity") >= LEAST), "links")
    label = components(tried)
    named = near.join(label, "th", "left").select("key", "th", F.coalesce("component", "th").alias("component"))
    named = few_stored(named, "named")
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    mixed = few_stored(mixed, "mixed")
    rest = few_stored(skew_join(named, mixed, "key", top, "th").select("th", "component").distinct(), "rest")
    discard(near, named, mixed, sizes)
    pairs = prefix_pairs(rest, texts)
    more = few_stored(verified(pairs, texts).where(F.col("similarity") >= LEAST), "links")
    every = signed.select("th").join(label, "th", "left").select("th", F.coalesce("component", "th").alias("component"))
    if more.limit(1).count():
        # components of the first links are single texts now, and the further links are between them
        own = rest.select(F.col("th").alias("a"), F.col("component").alias("ca"))
        other = rest.select(F.col("th").alias("b"), F.col("component").alias("cb"))
        joined = components(more.join(own, "a").join(other, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        joined = joined.select(F.col("th").alias("component"), F.col("component").alias("least"))
        every = salted_join(every, joined, "component", "th", "left").select("th", F.coalesce("least", "component").alias("component"))
    every = few_stored(every, "components")
    if not described:
        discard(pairs, rest, texts, signed, label, tried, more)
        return every
    links = tried.unionByName(more)
    sides = links.select(F.col("a").alias("th"), "similarity").unionByName(links.select(F.col("b").alias("th"), "similarity"))
    sides = sides.groupBy("th").agg(F.count("*").alias("n_links"), F.max("similarity").alias("best"))
    near = verified(every.where("th <> component").select(F.col("th").alias("a"), F.col("component").alias("b")), texts)
    out = every.join(sides, "th", "left").join(near.select(F.col("a").alias("th"), "similarity"), "th", "left")
    sizes = every.groupBy("component").agg(F.count("*").alias("class_texts"))
    out = salted_join(out, sizes, "component", "th")
    out = stored(out.select("th", "component", "class_texts", F.coalesce("similarity", F.lit(1.0)).alias("similarity"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "best"), "classes")
    discard(pairs, rest, texts, signed, label, tried, more, every)
    return out


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, text_id (its exact class), class_id (its near-duplicate class: the least text_id), class_texts (distinct
    texts of the class), similarity (to the text that class_id names), n_links, best of each row, ids as hex.

    n_links counts the verified links by which the text was put into its class, a spanning set of the class at least (links to
    texts that no bucket or prefix had to be tried for aren't counted); best is the greatest similarity of one."""
    rows = docs.select("doc_id", text_key().alias("th"))
    named = salted_join(rows, near_classes(docs, **how), "th", "doc_id")
    ids = [F.lower(F.hex(c)).alias(n) for c, n in (("th", "text_id"), ("component", "class_id"))]
    return named.select("doc_id", *ids, "class_texts", F.round("similarity", 6).alias("similarity"), "n_links", F.round("best", 6).alias("best"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One row of each near-duplicate class, all columns: the least doc_id, then the least text, one of equal rows."""
    classes = near_classes(docs, described=False, **how)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), text_key().alias("t"), F.xxhash64(*columns).alias("h"))
    keyed = docs.select(F.struct(*columns).alias("row"), order.alias("id"))
    named = salted_join(keyed.select("id", F.col("id.t").alias("th")), classes, "th", "id")
    chosen = named.groupBy("component").agg(F.min("id").alias("id")).select("id")
    return keyed.dropDuplicates(["id"]).join(chosen, "id", "left_semi").select("row.*")


# All pairs of texts that share a shingle, and what can be reached by links.
CLASSES_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS id FROM documents),
t AS (SELECT id, {WORDS_SQL} AS w FROM (SELECT id, any_value(text) AS text FROM d GROUP BY id)),
s AS (SELECT id, sh, count(*) AS n FROM (SELECT id, array_to_string(w[k : k + 4], ' ') AS sh FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM t WHERE len(w) > 0)) GROUP BY ALL),
z AS (SELECT id, sum(n) AS size FROM s GROUP BY id),
o AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS low FROM s a JOIN s b ON a.sh = b.sh AND a.id < b.id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE 5 * low >= 4 * (x.size + y.size - low)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id AS a, id AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS id, min(b) AS class_id, count(*) AS class_texts FROM r GROUP BY a)
SELECT doc_id, d.id AS text_id, c.class_id, class_texts, round(CASE WHEN d.id = c.class_id THEN 1 ELSE coalesce(low / (x.size + y.size - low)::DOUBLE, 0) END, 6) AS similarity
FROM d JOIN c USING (id) LEFT JOIN o ON o.a = c.class_id AND o.b = d.id LEFT JOIN z x ON x.id = d.id LEFT JOIN z y ON y.id = c.class_id
"""
