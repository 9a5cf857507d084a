"""Personal data by weak supervision, in Spark columns only.

Patterns propose candidate spans. Four labelers (form, gazetteer, context words, look of the value) vote on each: for (1),
against (-1) or not at all (0). Spark counts the vote patterns over all documents; expectation-maximisation over those counts
(a bounded table: kinds x 3^4 votes x 4 x 4 features) estimates how each labeler votes on personal data and on other spans,
and each pattern's probability of being personal data. Those probabilities train a logistic span classifier on votes and features, which is compiled back
into a Spark column. Base spans (the valid e-mail addresses, IP addresses, card and phone numbers) always stay; the method
adds candidates of other kinds (secrets, national numbers, bank accounts) that its classifier accepts.

Patterns have possessive repeats and are anchored at the start of a run, or where the match before ended, so that no text
makes them quadratic or deep; they find the same leftmost matches as the plain patterns.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LOCAL, DIGIT = r"A-Za-z0-9._%+-", "0-9"
#: kind -> (pattern, a cheap test that every text with a match passes). Order of the kinds breaks ties of equal starts.
BASE = {
    "email": (rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9]){13,}+", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
ADDED = {
    "secret": (r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+(?![A-Za-z0-9_+/=-])", None),
    "national_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None),
}
KINDS = [*BASE, *ADDED]
#: Code points before a span that are looked at; matches before it that hold so many (the shortest have four).
LEFT, BACK = 24, 7
#: Whole words before a span that speak for its kind, and words that speak against any.
CUES = {
    "email": "e-?mail|contact|write|reach",
    "ip": "ip|host|server|address|addr|from|client",
    "card": "card|visa|credit|payment|pay|mastercard",
    "phone": "telephone|phone|tel|call|mobile|fax|contact",
    "secret": "token|secret|key|password|passwd|pwd|auth|authorization|credential|bearer",
    "national_id": "ssn|social|security|national|id",
    "iban": "iban|account|bank|transfer",
}
AGAINST = "version|isbn|issn|doi|commit|sha|sha1|sha256|md5|checksum|uuid|order|page|build|https?"
#: Names and number ranges that speak for a kind.
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|co)$",
    "ip": r"^(?!0|127\.|255\.)[0-9.]++$",
    "card": r"^[3-6]",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"^(?:AKIA|ASIA|ghp_|gho_|sk-|xox|eyJ|AIza|glpat-)",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "iban": r"^(?:AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
}
FORM = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,}$",
    "ip": r"^(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})$",
    "card": r"^(?:[0-9]{14,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7})$",
    "phone": r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .0-9-]++$",
    "secret": r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_+/=-]{20,})$",
    "national_id": r"^(?!.*([0-9])\1{3})(?!123-45|.*-1234$)[0-9-]{11}$",
    "iban": r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11,36}$",
}
VOTES = ("form", "gazetteer", "context", "look")
ROUNDS = 40
#: Pseudo-counts of a labeler's right votes, and of its wrong ones and its abstentions.
RIGHT, WRONG = 8.0, 2.0


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(
        F.when(d.try_cast("int") > 4, d.try_cast("int") * 2 - 9).otherwise(d.try_cast("int") * 2)
    ))
    total = F.aggregate(values, F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0)))
    return total % 10 == 0


def is_valid(kind: str, value: Column) -> Column:
    """The base kinds' own test of a match; others have none."""
    digits = digits_of(value)
    if kind == "ip":
        small = F.transform(
            F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        )
        parts = F.transform(F.split(value, r"\."), lambda p: F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 4).cast("int") <= 255)
        return F.forall(small, lambda x: x) & F.forall(parts, lambda x: x)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


SPAN = "struct<start:int,end:int,kind:string,value:string,left:string>"


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running sums, or maxima, of an array: in the k-th of log2(n) rounds each value takes in the one 2^k places before."""
    rounds = F.ceil(F.log2(F.size(values))).cast("int")

    def widen(done: Column, k: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(done, lambda x, i: F.when(i >= step, combine(x, F.get(done, i - step))).otherwise(x))

    return F.when(F.size(values) > 1, F.aggregate(F.sequence(F.lit(0), rounds - 1), values, widen)).otherwise(values)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def spans_of(text: Column, kind: str) -> Column:
    """Array of the valid matches of one kind, with code-point offsets (end exclusive) and what stands before, in order.

    Offsets are running sums over gaps and matches, and what stands before a match is put together from the ends of the
    pieces before it: the work grows with the text and, but for the rounds of the sums, with the number of matches.
    """
    pattern, needs = (BASE | ADDED)[kind]

    def found(values: Column) -> Column:
        return bound(F.split(text, pattern, -1), lambda gaps: placed(values, gaps))

    def placed(values: Column, gaps: Column) -> Column:
        steps = F.transform(values, lambda v, i: F.length(v) + F.length(F.get(gaps, i)))
        tails = F.transform(values, lambda v, i: F.right(F.concat(F.right(F.get(gaps, i), F.lit(LEFT + 1)), v), F.lit(LEFT + 1)))
        return bound(running(steps, lambda x, y: x + y), lambda ends: bound(tails, lambda held: listed(values, gaps, ends, held)))

    def listed(values: Column, gaps: Column, ends: Column, tails: Column) -> Column:
        def span(v: Column, i: Column) -> Column:
            # Every match has a few characters, so that some matches before this one reach back far enough.
            before = F.array_join(F.slice(tails, F.greatest(i - BACK, F.lit(0)) + 1, F.least(i, F.lit(BACK))), "")
            left = F.right(F.concat(before, F.right(F.get(gaps, i), F.lit(LEFT + 1))), F.lit(LEFT + 1))
            end = F.get(ends, i)
            return F.struct((end - F.length(v)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), v.alias("value"), left.alias("left")).cast(SPAN)

        spans = F.transform(values, span)
        return F.filter(spans, lambda s: F.coalesce(is_valid(kind, s["value"]), F.lit(False)))

    some = text.rlike(pattern) if needs is None else text.contains(needs) & text.rlike(pattern)
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(some, bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)).otherwise(none)


def votes_on(kind: Column, value: Column, left: Column) -> list[Column]:
    """Four votes (1, 0, -1) and two features (of 0 to 3) of a candidate span."""

    def by_kind(table: dict[str, str], test) -> Column:
        return reduce(lambda c, k: c.when(kind == k, test(table[k])), KINDS, F).otherwise(F.lit(False))

    near = F.lower(left)
    says = lambda words: near.rlike(rf"(?<!\p{{L}})(?:{words})s?(?!\p{{L}})")
    form = F.when(by_kind(FORM, lambda p: value.rlike(p)), 1).otherwise(-1)
    known = F.when(by_kind(GAZETTEER, lambda p: value.rlike(p)), 1).otherwise(0)
    context = F.when(by_kind(CUES, says), 1).when(says(AGAINST), -1).otherwise(0)
    distinct = F.size(F.array_distinct(F.split(F.substring(value, 1, 64), "")))
    figures = F.length(digits_of(F.substring(value, 1, 128)))
    length = F.least(F.length(value), F.lit(128))
    mixed = (figures * 4 >= length) & (distinct >= 5)
    look = F.when((distinct <= 3) | (figures == 0) & (kind != "email"), -1).when(mixed, 1).otherwise(0)
    size = F.when(length < 16, 0).when(length < 32, 1).when(length < 64, 2).otherwise(3)
    share = F.when(figures == 0, 0).when(figures * 4 < length, 1).when(figures < length, 2).otherwise(3)
    return [
        form.alias("form"), known.alias("gazetteer"), context.alias("context"), look.alias("look"),
        size.alias("size"), share.alias("share"),
    ]


@dataclass(frozen=True)
class SpanModel:
    """How often each labeler's votes are right, by class and among its votes, and the weights of the span classifier."""

    reliability: dict[str, tuple[float, float]]
    weights: dict[tuple, float]

    def probability(self, kind: Column, signs: dict[str, Column]) -> Column:
        total = F.lit(self.weights.get(("bias",), 0.0))
        for key, w in sorted(self.weights.items(), key=repr):
            if key[0] == "kind":
                total = total + F.when(kind == key[1], F.lit(w)).otherwise(0.0)
            elif key[0] != "bias":
                total = total + F.when(signs[key[0]] == key[1], F.lit(w)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def estimate(counts: list[tuple[str, tuple[int, ...], tuple[int, int], int]]) -> SpanModel:
    """Expectation-maximisation over (kind, votes, features, count), then the span classifier.

    Each labeler has a distribution over its three votes for personal data and one for other spans, the same for all kinds;
    a kind has its share of personal data. The start is the majority of the votes. Pseudo-counts, by which right votes are
    likelier than wrong ones, keep every probability inside (0, 1) and the two classes from changing places.
    """
    posterior = [1 / (1 + math.exp(-1.4 * sum(v))) for _, v, _, _ in counts]
    table: dict[tuple[str, bool, int], float] = {}
    for _ in range(ROUNDS):
        for k, name in enumerate(VOTES):
            for real in (True, False):
                mass = {v: RIGHT if (v > 0) == real else WRONG for v in (1, -1)} | {0: WRONG}
                for (_, votes, _, c), p in zip(counts, posterior, strict=True):
                    mass[votes[k]] += c * (p if real else 1 - p)
                for v, m in mass.items():
                    table[name, real, v] = m / sum(mass.values())
        prior = {}
        for kind in KINDS:
            own = [(c, p) for (x, _, _, c), p in zip(counts, posterior, strict=True) if x == kind]
            prior[kind] = (1 + sum(c * p for c, p in own)) / (2 + sum(c for c, _ in own))
        for n, (kind, votes, _, _) in enumerate(counts):
            logit = math.log(prior[kind] / (1 - prior[kind]))
            for name, v in zip(VOTES, votes, strict=True):
                logit += math.log(table[name, True, v] / table[name, False, v])
            posterior[n] = 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))

    def right(name: str, real: bool) -> float:
        said = {v: table[name, real, v] for v in (1, -1)}
        return said[1 if real else -1] / sum(said.values())

    reliable = {name: (right(name, True), right(name, False)) for name in VOTES}

    def active(kind: str, votes: tuple[int, ...], features: tuple[int, int]) -> list[tuple]:
        named = [(n, v) for n, v in zip(VOTES, votes, strict=True) if v]
        return [("bias",), ("kind", kind), *named, ("size", features[0]), ("share", features[1])]

    weights: dict[tuple, float] = {}
    total = sum(c for *_, c in counts) or 1
    for _ in range(300):  # logistic regression on the posteriors, by counts; decay holds rare weights near zero
        slope: dict[tuple, float] = {}
        for (kind, votes, features, c), p in zip(counts, posterior, strict=True):
            keys = active(kind, votes, features)
            guess = 1 / (1 + math.exp(-sum(weights.get(k, 0.0) for k in keys)))
            for k in keys:
                slope[k] = slope.get(k, 0.0) + c * (p - guess) / total
        for k, s in slope.items():
            weights[k] = weights.get(k, 0.0) + 2.0 * s - 0.0002 * weights.get(k, 0.0)
    return SpanModel(reliable, weights)


def candidates(text: Column) -> Column:
    """All candidate spans of a text (null: none), base kinds first."""
    t = F.coalesce(text, F.lit(""))
    return F.concat(*[spans_of(t, k) for k in KINDS])


def left_of(span: Column) -> Column:
    """The LEFT code points before a span, without the rest of a word that is cut at their start."""
    return F.when(span["start"] > LEFT + 1, F.regexp_replace(span["left"], r"^\p{L}+", "")).otherwise(span["left"])


def train(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Vote patterns of all candidates of all documents, counted by Spark, and the model estimated from the counts."""
    text = F.coalesce(docs[text_col], F.lit(""))
    spans = docs.select(F.explode(candidates(text)).alias("s"))
    voted = spans.select(F.col("s.kind").alias("kind"), *votes_on(F.col("s.kind"), F.col("s.value"), left_of(F.col("s"))))
    names = ["kind", *VOTES, "size", "share"]
    counted = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).orderBy(*names).collect()
    return estimate([(r.kind, tuple(r[v] for v in VOTES), (r["size"], r["share"]), r.n) for r in counted])


def clear_of(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others (both not empty).

    Among the others that start before a span's end, found by halving, the furthest end is compared with the span's start.
    """

    def against(sorted_: Column) -> Column:
        starts = F.transform(sorted_, lambda b: b["start"])
        reach = running(F.transform(sorted_, lambda b: b["end"]), F.greatest)
        bits = F.sequence(F.ceil(F.log2(F.size(sorted_) + 1)).cast("int"), F.lit(0))
        return bound(starts, lambda at: bound(reach, lambda to: bound(bits, lambda steps: F.filter(spans, lambda s: clear(s, at, to, steps)))))

    def clear(s: Column, starts: Column, reach: Column, bits: Column) -> Column:
        def further(count: Column, bit: Column) -> Column:
            more = count + F.call_function("shiftleft", F.lit(1), bit)
            return F.when(F.coalesce(F.get(starts, more - 1) < s["end"], F.lit(False)), more).otherwise(count)

        before = F.aggregate(bits, F.lit(0), further)
        return F.coalesce(F.get(reach, before - 1) <= s["start"], F.lit(True))

    return bound(F.array_sort(F.transform(others, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))), against)


def with_spans(docs: DataFrame, model: SpanModel, column: str, text_col: str = "text") -> DataFrame:
    """The documents with an array column of spans (start, end, kind, value), by start and then kind.

    All base spans, and those of the added kinds that the classifier gives a half or more. An added span that overlaps a base
    span is left out. Null and empty texts have an empty array.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    found = F.col("_qm_candidates")

    def accepted(s: Column) -> Column:
        signs = dict(zip([*VOTES, "size", "share"], votes_on(s["kind"], s["value"], left_of(s)), strict=True))
        return model.probability(s["kind"], signs) >= 0.5

    base = F.filter(found, lambda s: s["kind"].isin(*BASE))
    added = F.filter(found, lambda s: ~s["kind"].isin(*BASE))
    added = F.when(F.size(added) > 0, F.filter(added, accepted)).otherwise(added)
    free = F.when((F.size("_qm_added") > 0) & (F.size("_qm_base") > 0), clear_of(F.col("_qm_added"), F.col("_qm_base"))).otherwise(F.col("_qm_added"))
    order = {k: n for n, k in enumerate(KINDS)}
    rank = lambda k: reduce(lambda c, x: c.when(k == x, order[x]), KINDS, F).otherwise(len(KINDS))
    tagged = F.transform(
        F.concat("_qm_base", free),
        lambda s: F.struct(s["start"].alias("start"), rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")),
    )
    spans = F.transform(
        F.array_sort(tagged),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")),
    )
    out = docs.withColumn("_qm_candidates", candidates(text))
    out = out.withColumns({"_qm_base": base, "_qm_added": added}).withColumn(column, spans)
    return out.drop("_qm_candidates", "_qm_base", "_qm_added")


#: Code points of a piece that a text is cut into, so that a place in it is reached without walking over the whole text.
PIECE = 1024


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in square brackets; overlapping spans are replaced once.

    Spans are by start. What the spans before one reach is their running maximum of ends; the text from there to its start
    stays. All pieces are joined at once.
    """

    def between(pieces: Column, start: Column, end: Column) -> Column:
        first = (start / PIECE).cast("int")
        held = F.array_join(F.slice(pieces, first + 1, (end / PIECE).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(held, start - first * PIECE + 1, end - start)).otherwise("")

    def replaced(pieces: Column, reach: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            since = F.coalesce(F.get(reach, i - 1), F.lit(0))
            return F.when(s["start"] >= since, F.concat(between(pieces, since, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

        rest = between(pieces, F.element_at(reach, -1), F.length(text))
        return F.concat(F.array_join(F.transform(spans, part), ""), rest)

    reach = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    whole = bound(cut, lambda pieces: bound(reach, lambda to: replaced(pieces, to)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op1_pii(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs, train(docs), "found")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
