"""Personal data by weak supervision, in DataFrame operations only.

Four base kinds follow fixed patterns and checks. Beyond them, candidate spans (numbers written like telephone numbers
without a plus sign, and credentials) are voted on by labelers: a pattern, a gazetteer and the words before the span.
Expectation-maximisation estimates how reliable each labeler is from the votes alone, over all candidates of the corpus,
and a logistic span classifier is trained on the resulting probabilities; what it accepts is added to the spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Base kinds in their order and what their matches must look like. Runs of one class are possessive and
#: start where the class does, which finds the same leftmost matches without trying again from every character. Of the
#: digits that may be a card only runs of 13 and more are matches at all: a shorter run has no part that is long enough.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?=(?:[0-9][\x20-]?){12}[0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a kind to be looked for.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "card": ""}
#: Kinds of candidates beyond the base, in the order in which their spans follow (telephones among the base's).
CANDIDATES = {
    "phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20./-][0-9]{2,4}[\x20./-][0-9]{3,5}(?![0-9A-Za-z.-])",
    "secret": r"(?<![0-9A-Za-z_-])(?:AKIA[0-9A-Z]{16}|(?:gh[oprsu]_|github_pat_|sk-|xox[abprs]-)[0-9A-Za-z_-]{16,}+|[0-9a-f]{16,}+)(?![0-9A-Za-z_-])",
}
ORDER = {"email": 0, "ip": 1, "card": 2, "phone": 3, "secret": 4}
#: Words that the context labeler looks for in the WINDOW characters before a candidate; prefixes that the gazetteer knows.
CONTEXT = {"phone": "tel|phone|call|fax|mobile|telefon|rufen|appel", "secret": "key|token|secret|passw|pwd|auth|credential"}
GAZETTEER = {"phone": r"^\(?(?:0|1[\x20.-])", "secret": r"^(?:AKIA|gh[oprsu]_|github_pat_|sk-|xox[abprs]-)"}
SHAPE = {"phone": r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$", "secret": r"^(?=.*[0-9])(?=.*[A-Za-z])"}
WINDOW, ROUNDS, PRIOR = 24, 30, {"phone": 0.3, "secret": 0.5}
LABELERS = ("shape", "gazetteer", "context")
#: What the classifier sees of a span besides the votes: a middling length, many digits, upper case.
FIGURES = ("long", "digits", "upper")
#: Matches that are placed one after the other at once.
BLOCK = 128


def matches(text: Column, pattern: str, needs: str = "") -> Column:
    """Array of (start, end, found) of the pattern's matches, in code points, end exclusive.

    Appending to an array copies it, so places are summed up within blocks of BLOCK matches, and the blocks' ends after."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    kind = "array<struct<start:int,end:int,found:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("all"))
    step = lambda s, x: F.struct(
        (s["at"] + F.length(x["b"]) + F.length(x["f"])).alias("at"),
        F.array_append(s["all"], F.struct((s["at"] + F.length(x["b"])).alias("start"), (s["at"] + F.length(x["b"]) + F.length(x["f"])).alias("end"), x["f"].alias("found"))).alias("all"),
    )
    pieces = F.zip_with(between, found, lambda b, f: F.struct(b.alias("b"), f.alias("f")))
    # a lambda that names the pieces would split the text again for each block: they are made once, as the only element
    blocks = F.transform(F.array(pieces), lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(p) - 1) / BLOCK).cast("int"), F.lit(0))), lambda k: F.aggregate(F.slice(p, k * BLOCK + 1, F.lit(BLOCK)), zero, step)))
    joined = lambda s, x: F.struct(
        (s["at"] + x["at"]).alias("at"),
        F.array_append(s["all"], F.transform(x["all"], lambda y: F.struct((s["at"] + y["start"]).alias("start"), (s["at"] + y["end"]).alias("end"), y["found"].alias("found")))).alias("all"),
    )
    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("all"))
    placed = F.flatten(F.aggregate(F.flatten(blocks), none, joined, lambda s: s["all"]))
    may = text.rlike(pattern)
    return F.when((F.instr(text, needs) > 0) & may if needs else may, placed).otherwise(F.array().cast(kind))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the last digit of a string of digits checks the others."""
    figures = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(figures, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 4).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(found, r"\."), part)
    if kind == "card":
        n = F.length(digits(found))
        return F.when(n.between(13, 19), luhn(digits(found))).otherwise(False)
    if kind == "phone":
        return F.length(digits(found)).between(9, 15)
    return F.lit(True)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base spans by kind, and candidates with the labelers' votes; one pass over the whole texts."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", text.alias("_text"))
    fine = lambda kind: lambda x: valid(kind, x["found"])
    spans = {k: F.filter(matches(F.col("_text"), PATTERNS[k], NEEDS[k]), fine(k)) for k in KINDS}

    def votes(kind: str):
        def vote(x: Column) -> Column:
            before = F.lower(F.substring(F.col("_text"), F.greatest(x["start"] - WINDOW, F.lit(0)) + 1, F.least(x["start"], F.lit(WINDOW))))
            return F.struct(
                F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["found"].rlike(SHAPE[kind]).cast("int").alias("shape"),
                x["found"].rlike(GAZETTEER[kind]).cast("int").alias("gazetteer"), before.rlike(CONTEXT[kind]).cast("int").alias("context"),
                F.length(x["found"]).between(17, 40).cast("int").alias("long"),
                (4 * F.length(digits(x["found"])) >= F.length(x["found"])).cast("int").alias("digits"), x["found"].rlike("[A-Z]").cast("int").alias("upper"),
            )

        return vote

    more = [F.transform(matches(F.col("_text"), pattern), votes(kind)) for kind, pattern in CANDIDATES.items()]
    return out.select("doc_id", *(F.transform(spans[k], lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k) for k in KINDS), F.concat(*more).alias("more"))


def reliabilities(votes: list[tuple[tuple[int, ...], int]], prior: float) -> tuple[float, list[tuple[float, float]], list[float]]:
    """Expectation-maximisation over (votes, count): the share of true candidates, each labeler's chance to vote for a
    true and for a false one, and each voting pattern's probability to be true."""
    total = sum(n for _, n in votes)
    share, rates = prior, [(0.7, 0.2)] * len(LABELERS)
    chance = [share] * len(votes)
    for _ in range(ROUNDS):
        for i, (v, _) in enumerate(votes):
            yes, no = math.log(share), math.log(1 - share)
            for x, (a, b) in zip(v, rates, strict=False):
                yes, no = yes + math.log(a if x else 1 - a), no + math.log(b if x else 1 - b)
            chance[i] = 1 / (1 + math.exp(min(500, no - yes)))
        true = sum(c * n for c, (_, n) in zip(chance, votes, strict=True))
        share = min(0.99, max(0.01, (true + 1) / (total + 2)))
        # a labeler is taken to be better than chance, or true and false could change places
        vote = lambda j, of: sum(of(c) * n * v[j] for c, (v, n) in zip(chance, votes, strict=True))
        rates = [(min(0.99, max(0.5, vote(j, lambda c: c) / max(true, 1e-9))), max(0.01, min(0.5, vote(j, lambda c: 1 - c) / max(total - true, 1e-9)))) for j in range(len(LABELERS))]
    return share, rates, chance


def classifier(rows: list[tuple[tuple[int, ...], float, int]], steps: int = 400) -> list[float]:
    """Weights (bias first) of a logistic classifier fitted to (features, probability, count) by gradient steps."""
    total = sum(n for *_, n in rows) or 1
    w = [0.0] * (len(rows[0][0]) + 1)
    for _ in range(steps):
        grad = [0.01 * x for x in w]
        for x, p, n in rows:
            z = w[0] + sum(a * b for a, b in zip(w[1:], x, strict=True))
            g = (1 / (1 + math.exp(-max(-50, min(50, z)))) - p) * n / total
            grad[0] += g
            for j, v in enumerate(x):
                grad[j + 1] += g * v
        w = [a - 1.0 * g for a, g in zip(w, grad, strict=True)]
    return w


def train(found: DataFrame) -> dict[str, list[float]]:
    """The classifiers' weights from all candidates: their tally by kind, votes and figures has 128 rows at most."""
    names = [*LABELERS, *FIGURES]
    tally = found.select(F.explode("more").alias("x")).select("x.*").groupBy("kind", *names).count().collect()
    out = {}
    for kind in CANDIDATES:
        rows = sorted(((tuple(r[n] for n in names), r["count"]) for r in tally if r["kind"] == kind))
        if rows:
            # a labeler votes on the span, so rows of other figures but the same votes count together
            chance = reliabilities([(v[: len(LABELERS)], n) for v, n in rows], PRIOR[kind])[2]
            out[kind] = classifier([(v, p, n) for (v, n), p in zip(rows, chance, strict=True)])
    return out


def find(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, an array (start, end) of each base kind, and spans (kind, start, end).

    Null text counts as empty; an empty text has no spans. Base spans always stay; an added span that overlaps one goes.
    Repeated rows and null identifiers are rows like any other; an empty table gives an empty result.
    """
    found = written(scan(docs), "pii-spans")
    weights = train(found)

    def accepted(x: Column) -> Column:
        case = F.lit(False)
        for kind, w in weights.items():
            z = F.lit(w[0])
            for name, v in zip([*LABELERS, *FIGURES], w[1:], strict=True):
                z = z + x[name] * v
            case = F.when(x["kind"] == kind, z > 0).otherwise(case)
        return case

    span = lambda kind: lambda x: F.struct(F.lit(ORDER[kind]).alias("order"), x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"))
    base = F.concat(*(F.transform(k, span(k)) for k in KINDS))
    added = F.filter("more", lambda x: accepted(x) & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    rank = lambda kind: sum((F.when(kind == k, ORDER[k]).otherwise(0) for k in CANDIDATES), F.lit(0)).cast("int")
    added = F.transform(added, lambda x: F.struct(rank(x["kind"]).alias("order"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return found.select("doc_id", *KINDS, base.alias("base"), F.array_sort(F.concat(base, added)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
