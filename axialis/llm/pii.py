"""Personal data spans by weak supervision, in DataFrame functions only.

Candidates are the base patterns of four kinds (email, ip, card, phone; leftmost, non-overlapping within a kind)
and two loose forms: written-out e-mail addresses ("name at host dot org") and phone numbers without a plus sign.
Four labelers vote on each candidate for (1), against (-1) or not at all (0): the pattern with its check (octets,
Luhn, digits), a gazetteer (domain ends, country codes, card issuers, reserved networks), the words before the
span, and the characters next to it. Expectation-maximisation over the counts of vote patterns of all documents
estimates the labelers' reliabilities by kind and the chance that a candidate is personal data; a logistic span
classifier is then trained on those chances as soft labels, from counts of feature patterns. Both count tables are
bounded by the number of patterns, not by the corpus. Base spans stay whatever the classifier says; loose ones are
added where it accepts them and they touch no base span.

Patterns are written with possessive groups and start only where a run of their characters starts or the last
match ended, so they run in linear time and stack on any text and match the same spans.

Every row's text is searched where it lies; the candidates of equal texts are then merged under the text's MD5, so
labels are computed once for each, and each of their rows gets the same spans (a text of most rows by salts).

Defined cases: a null text is empty;
null and repeated doc_ids keep their rows; positions are code points, ends exclusive.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few_parts, salted_join, stored

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.()-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])",
}
NEED = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
LOOSE_NEED = {"email": r"\(at\)|\[at\]| at ", "phone": "[0-9][ .)-]+[0-9]{3}"}
DOMAINS = "com|org|net|edu|gov|io|info|de|fr|es|uk|it|nl|eu|example|test"
CODES = r"\+(?:1|7|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
WORDS = {
    "email": "mail|contact|write|reach",
    "ip": "ip|host|server|address|from|login",
    "card": "card|visa|master|credit|payment|account",
    "phone": "phone|tel|call|mobile|fax|number|contact",
}
AGAINST = r"(?:version|release|isbn|token|hash|sha|uuid|page|vol|section|order)[^a-z]*$"
LABELERS = ("v_regex", "v_gazetteer", "v_context", "v_shape")
PRIOR = ({-1: 0.6, 0: 0.3, 1: 0.1}, {-1: 0.1, 0: 0.3, 1: 0.6})
HOLD = 0.1
FEATURES = ("loose", "long", "left_word", "right_word", *LABELERS)


def _candidates(text: Column, kind: str, loose: bool) -> Column:
    """Array of struct(kind, loose, i, gap, hit, before, after) of one pattern's matches."""
    pattern, need = (LOOSE[kind], LOOSE_NEED[kind]) if loose else (BASE[kind], NEED[kind])
    both = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("parts")))

    def of(hits: Column, parts: Column) -> Column:
        return F.transform(
            hits,
            lambda hit, i: F.struct(
                F.lit(kind).alias("kind"), F.lit(loose).alias("loose"), i.alias("i"), F.length(F.get(parts, i)).alias("gap"), hit.alias("hit"),
                F.lower(F.right(F.get(parts, i), F.lit(32))).alias("before"), F.left(F.get(parts, i + 1), F.lit(1)).alias("after"),
            ),
        )

    made = F.flatten(F.transform(both, lambda x: of(x["hits"], x["parts"])))  # one element: hits and parts are made once
    empty = F.expr("cast(array() as array<struct<kind:string,loose:boolean,i:int,gap:int,hit:string,before:string,after:string>>)")
    return F.when(text.rlike(need), made).otherwise(empty)


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _octets(hit: Column) -> Column:
    def small(part):
        bare = F.regexp_replace(part, "^0+", "")
        return F.when(F.length(bare) > 3, False).when(bare == "", True).otherwise(F.substring(bare, 1, 3).cast("int") <= 255)

    return F.forall(F.split(hit, "[.]"), small)


def _valid() -> Column:
    digits = F.regexp_replace("hit", "[^0-9]", "")
    n = F.length(digits)
    kind = F.col("kind")
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", _octets(F.col("hit")))
        .when(kind == "card", F.when(n.between(16, 19), luhn(digits)).otherwise(False))
        .otherwise(n.between(8, 15))
    )


def _votes(c: DataFrame) -> DataFrame:
    kind, hit = F.col("kind"), F.lower("hit")
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    known = (
        F.when(kind == "email", hit.rlike(rf"(?:\.|dot[)\]]? ?)(?:{DOMAINS})$"))
        .when(kind == "phone", hit.rlike(f"^{CODES}") | F.col("loose") & hit.rlike(r"^\(?(?:0[1-9]|[2-9])"))
        .when(kind == "card", hit.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"))
        .otherwise(~hit.rlike(r"^(?:0|127|255)\."))
    )
    about = F.lit(False)
    for k, words in WORDS.items():
        about = F.when(kind == k, F.col("before").rlike(f"(?:{words})[^a-z]*$")).otherwise(about)
    c = c.withColumn("left_word", F.col("before").rlike(r"[\p{L}\p{N}_@/]$").cast("int"))
    c = c.withColumn("right_word", F.coalesce(F.col("after"), F.lit("")).rlike(r"[\p{L}\p{N}_@/]").cast("int"))
    c = c.withColumn("long", (F.length("hit") > 24).cast("int"))
    c = c.withColumn("v_regex", F.when(F.col("loose"), F.when(F.col("valid"), 0).otherwise(-1)).otherwise(vote(F.col("valid"), ~F.col("valid"))))
    c = c.withColumn("v_gazetteer", vote(known, ~known))
    c = c.withColumn("v_context", vote(about, F.col("before").rlike(AGAINST)))
    return c.withColumn("v_shape", vote((F.col("left_word") + F.col("right_word")) == 0, (F.col("left_word") + F.col("right_word")) == 2))


def candidates(docs: DataFrame) -> DataFrame:
    """One row for each candidate of each distinct text: th, kind, loose, start, end, valid, features, copies."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.unhex(F.md5(text.cast("binary"))).alias("th"), text.alias("text"))
    every = [_candidates(F.col("text"), k, False) for k in KINDS] + [_candidates(F.col("text"), k, True) for k in LOOSE]
    rows = keyed.select("th", F.explode(F.concat(*every)).alias("c")).select("th", "c.*")
    once = rows.groupBy("th", "kind", "loose", "i").agg(F.first("gap").alias("gap"), F.first("hit").alias("hit"), F.first("before").alias("before"), F.first("after").alias("after"), F.count("*").alias("copies"))
    order = Window.partitionBy("th", "kind", "loose").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("hit")
    once = once.withColumn("end", F.sum(F.col("gap") + size).over(order)).withColumn("start", F.col("end") - size)
    return _votes(once.withColumn("valid", _valid())).select("th", "kind", "loose", "start", "end", "valid", "copies", "left_word", "right_word", "long", *LABELERS)


def reliabilities(counts: list[tuple[tuple[int, ...], float]], turns: int = 30) -> dict[tuple[int, ...], float]:
    """Expectation-maximisation over patterns (loose, votes): the chance of each to be personal data.

    Base and loose candidates have shares of their own, as loose forms are rarely personal data in most corpora.

    Each labeler has a distribution over its three votes for either class, held towards PRIOR by a share of the
    candidates: a vote for is likelier under the positive class, one against under the negative. This names the
    classes, and keeps the weight of a rare vote, such as a word before the span that speaks against it."""
    total = sum(n for _, n in counts)
    hold = max(1.0, HOLD * total)
    chance = {p: 1 / (1 + exp(-1.5 * sum(p[1:]))) for p, _ in counts}
    for _ in range(turns):
        mass = [sum(n * (chance[p] if y else 1 - chance[p]) for p, n in counts) for y in (0, 1)]
        share = {}
        for loose in (0, 1):
            own = [(chance[p], n) for p, n in counts if p[0] == loose]
            share[loose] = (sum(c * n for c, n in own) + 1.0) / (sum(n for _, n in own) + 2.0)
        seen = [[{x: 0.0 for x in (-1, 0, 1)} for _ in LABELERS] for _ in (0, 1)]
        for p, n in counts:
            for y in (0, 1):
                for k, x in enumerate(p[1:]):
                    seen[y][k][x] += n * (chance[p] if y else 1 - chance[p])
        for p, _ in counts:
            odds = log(share[p[0]]) - log(1 - share[p[0]])
            for k, x in enumerate(p[1:]):
                q = [(seen[y][k][x] + hold * PRIOR[y][x]) / (mass[y] + hold) for y in (0, 1)]
                odds += log(q[1]) - log(q[0])
            chance[p] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
    return chance


def span_classifier(rows: list[tuple[tuple[float, ...], float, float]], turns: int = 300, rate: float = 0.5) -> list[float]:
    """Logistic regression on (features, soft label, count); the last weight is the bias."""
    total = sum(n for *_, n in rows) or 1.0
    w = [0.0] * (len(rows[0][0]) + 1 if rows else 1)
    for _ in range(turns):
        g = [1e-3 * x for x in w]
        for x, y, n in rows:
            s = w[-1] + sum(a * b for a, b in zip(x, w, strict=False))
            d = (1 / (1 + exp(-max(-30.0, min(30.0, s)))) - y) * n / total
            for k, a in enumerate(x):
                g[k] += d * a
            g[-1] += d
        w = [a - rate * b for a, b in zip(w, g, strict=True)]
    return w


def accepted(found: DataFrame) -> DataFrame:
    """Adds `score` and `accept` to candidates."""
    names = [F.col(c).cast("int").alias(c) for c in FEATURES]
    counts = found.groupBy("kind", *names).agg(F.sum("copies").alias("n")).orderBy("kind", *FEATURES).collect()
    score = F.lit(0.0)
    for kind in KINDS:
        own = [r for r in counts if r["kind"] == kind]
        if not own:
            continue
        votes: dict[tuple[int, ...], float] = {}
        for r in own:
            v = tuple(r[c] for c in ("loose", *LABELERS))
            votes[v] = votes.get(v, 0.0) + float(r["n"])
        chance = reliabilities(sorted(votes.items()))
        w = span_classifier([(tuple(float(r[c]) for c in FEATURES), chance[tuple(r[c] for c in ("loose", *LABELERS))], float(r["n"])) for r in own])
        line = F.lit(w[-1])
        for c, x in zip(FEATURES, w, strict=False):
            line = line + F.lit(x) * F.col(c).cast("double")
        score = F.when(F.col("kind") == kind, 1.0 / (1.0 + F.exp(-line))).otherwise(score)
    return found.withColumn("score", score).withColumn("accept", F.when(F.col("loose"), F.col("valid") & (F.col("score") >= 0.5)).otherwise(F.col("valid")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def private_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each row."""
    found = accepted(stored(few_parts(candidates(docs)), "candidates")).where("accept")
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    span = F.struct(place.alias("place"), "start", "end", "kind")
    lists = found.groupBy("th").agg(
        *[F.count(F.when((F.col("kind") == k) & ~F.col("loose"), 1)).alias(f"n_{k}") for k in KINDS],
        F.collect_list(F.when(~F.col("loose"), span)).alias("base"),
        F.collect_list(F.when(F.col("loose"), span)).alias("more"),
    )
    free = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    lists = lists.select("th", *[f"n_{k}" for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", free)).alias("spans"))
    rows = docs.select("doc_id", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("th"))
    out = salted_join(rows, lists, "th", "doc_id", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
