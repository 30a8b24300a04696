r"""Personal data by weak supervision, in DataFrame functions alone.

Patterns propose spans: the base kinds (e-mail, ip, card, phone), which always stay, and looser added kinds. Five
labelers vote for, against or not at all on each proposed span: a strict pattern or checksum of its kind, the shape of its
characters, a gazetteer (endings of domains, card prefixes, country codes and the like), the words before it, and what it adjoins.
Expectation-maximisation estimates, without labels, how reliable each labeler is on each kind from the counts of all vote patterns;
a kind with few spans leans on the rates of all kinds. Its posteriors train a logistic span classifier on kind, votes, votes within
the kind and length, which decides on the added spans.

Vote patterns are few whatever the input (kinds x 3^5 x lengths), so only their counts come to the driver, where both
fits are sums over them. The classifier goes back as a sum of literals, one expression a span.

Positions count code points; matched strings and the pieces between them give them by their lengths. The patterns avoid
nested backtracking: repeated groups are possessive, and a run of characters is only tried from its start, so very
long runs take linear time and no stack.

Cases: a null or empty text has no spans; matches that fail their kind's test are dropped without a retry; an added span
that overlaps a base one, or an added one of an earlier kind, is dropped; equal rows get equal results; an empty table
gives an empty result. Without proposed spans nothing is fitted.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash

BASE = ("email", "ip", "card", "phone")
ADDED = ("credential", "national_id", "iban", "local_phone", "spelled_email")
KINDS = BASE + ADDED
LABELERS = ("strict", "shape", "gazetteer", "context", "adjoining")
EM_ROUNDS = 60
LEAN = 30  # spans' worth of all kinds' rates that each kind starts from
FIT_ROUNDS = 300
THRESHOLD = 0.5
CONTEXT = 32

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){13,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "credential": r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b\s{0,2}[=:]\s{0,2}[\"']?[^\s\"']{6,}+[\"']?",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[0-9]{1,3}|[A-Z0-9]{1,3})?+\b",
    "local_phone": r"(?<![0-9+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "spelled_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{2,64}(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{2,24}){1,4}",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "national_id": "-", "spelled_email": "at"}

# Fixed values of the gazetteer.
DOMAIN_ENDINGS = r"(?i)\.(com|org|net|edu|gov|mil|int|info|biz|io|co|de|fr|es|it|uk|us|nl|be|ch|at|pt|pl|se|no|dk|fi|eu|ru|cn|jp|in|br|mx|ca|au)$"
CARD_PREFIXES = r"^(4|5[1-5]|2[2-7]|3[4-8]|30|6011|62|64|65)"
COUNTRY_CODES = r"^\+ ?(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[0-9]|37[0-9]|38[0-9]|42[01])"
IBAN_COUNTRIES = r"^(AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM)"
SAMPLE_IDS = r"^(123-45-6789|078-05-1120|219-09-9999|111-11-1111)$"
TRIGGERS = r"(?i)(mail|contact|write|correo|phone|tel|fax|call|mobile|anruf|ip|host|server|address|adresse|card|visa|master|karte|carte|tarjeta|ssn|social|iban|konto|account|login|user|password|secret|token)"
AGAINST = r"(?i)(version|release|isbn|issn|doi|fig|figure|table|chapter|section|page|article|order no|serial|model|part no)"


def proposals(text: Column, kind: str) -> Column:
    """array<struct<start, end, value, before>> of a kind's matches, leftmost and non-overlapping."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["piece"])
        end = start + F.length(x["value"])
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), F.right(x["piece"], F.lit(CONTEXT)).alias("before"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    pairs = F.filter(F.arrays_zip(pieces.alias("piece"), found.alias("value")), lambda x: x["value"].isNotNull())
    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])
    possible = F.regexp_like(text, F.lit(pattern))
    if kind in NEEDS:
        possible = F.contains(text, F.lit(NEEDS[kind])) & possible
    return F.when(possible, spans).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The test of a base kind's match."""
    digits = _digits(value)
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _overlaps(spans: Column, span: Column) -> Column:
    return F.exists(spans, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _remainder_97(value: Column) -> Column:
    """An account number's check: its first four characters moved to the end, letters as numbers from 10 on, modulo 97."""
    plain = F.upper(F.regexp_replace(value, " ", ""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    points = F.transform(F.filter(F.split(turned, ""), lambda c: F.length(c) == 1), lambda c: F.ascii(c))

    def add(rest: Column, point: Column) -> Column:
        return F.when(point >= 65, (rest * 100 + point - 55) % 97).otherwise((rest * 10 + point - 48) % 97)

    return F.aggregate(points, F.lit(0), add)


STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$",
    "ip": r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$",
    "card": r"^([0-9]{14,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{2,7}|[0-9]{4}([ -])[0-9]{6}\3[0-9]{4,5})$",
    "phone": r"^\+[0-9]{1,3}([ .-]?\(?[0-9]{2,}\)?)+$",
    "credential": r"[=:]\s{0,2}[\"']?(?=[^\s\"']*[0-9])(?=[^\s\"']*[A-Za-z])[^\s\"']{12,}",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "local_phone": r"^(\([0-9]{3}\) |[0-9]{3}([ .-]))[0-9]{3}[ .-][0-9]{4}$",
    "spelled_email": r"(\[at\]|\(at\)).*(\[dot\]|\(dot\))",
}


def strict(kind: str, value: Column) -> Column:
    """What is written exactly as its kind is, down to a checksum where there is one."""
    if kind == "iban":
        return _remainder_97(value) == 1
    return F.regexp_like(value, F.lit(STRICT[kind]))


def votes(kind: str, span: Column) -> Column:
    """struct of the labelers' votes: 1 for, -1 against, 0 none."""
    value, before = span["value"], span["before"]
    digits = _digits(value)
    distinct = F.size(F.array_distinct(F.split(digits, "")))
    if kind in ("email", "spelled_email"):
        shape, listed = _vote(F.lit(True), F.contains(value, F.lit(".."))), F.regexp_like(value, F.lit(DOMAIN_ENDINGS))
    elif kind == "credential":
        secret = F.regexp_replace(value, r"^[^=:]*[=:]", "")
        shape, listed = _vote(F.length(secret) >= 12, F.length(secret) < 8), F.regexp_like(secret, F.lit("[0-9]")) & F.regexp_like(secret, F.lit("[A-Za-z]"))
    else:
        shape = _vote(distinct > 3, distinct <= 3)
        listed = {
            "ip": ~F.regexp_like(value, F.lit(r"^(0|24[0-9]|25[0-9])\.")),
            "card": F.regexp_like(digits, F.lit(CARD_PREFIXES)),
            "phone": F.regexp_like(value, F.lit(COUNTRY_CODES)),
            "national_id": ~F.regexp_like(value, F.lit(SAMPLE_IDS)),
            "iban": F.regexp_like(value, F.lit(IBAN_COUNTRIES)),
            "local_phone": F.regexp_like(digits, F.lit("^[2-9]..[2-9]")),
        }[kind]
    context = _vote(F.regexp_like(before, F.lit(TRIGGERS)), F.regexp_like(before, F.lit(AGAINST)))
    adjoining = _vote(F.regexp_like(before, F.lit(r"(^|[\s\"'(<\[:,;])$")), F.regexp_like(before, F.lit(r"[A-Za-z0-9_/@=-]$")))
    exact = strict(kind, value)
    return F.struct(*[c.cast("int").alias(n) for n, c in zip(LABELERS, (_vote(exact, ~exact), shape, _vote(listed, ~listed), context, adjoining), strict=True)])


def _length_class(span: Column) -> Column:
    n = span["end"] - span["start"]
    return F.when(n < 12, 0).when(n < 20, 1).when(n < 32, 2).otherwise(3)


def _passing(kind: str) -> Callable[[Column], Column]:
    return lambda s: passes(kind, s["value"])


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def _free_of(kinds: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda s: ~reduce(lambda x, y: x | y, [_overlaps(F.col(k), s) for k in kinds])


def _span_of(kind: str, place: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(
        s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(kind in BASE).alias("base"), votes(kind, s).alias("votes"), _length_class(s).alias("len")
    )


def with_spans(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as a struct ``row``, and ``spans``: array<struct<start, place, end, kind, base, votes, len>> of base spans and proposed added ones, by start, then kind."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    out = rows.select("row", *[proposals(text, kind).alias(kind) for kind in KINDS])
    out = out.select("row", *[F.filter(kind, _passing(kind)).alias(kind) if kind in BASE else F.col(kind) for kind in KINDS])
    parts = []
    for i, kind in enumerate(KINDS):
        own = F.col(kind)
        if kind in ADDED:
            own = F.filter(own, _free_of(KINDS[:i]))
        parts.append(F.transform(own, _span_of(kind, i)))
    return out.select("row", F.array_sort(F.concat(*parts)).alias("spans"))


Pattern = tuple[str, tuple[int, ...], int]


def vote_patterns(marked: DataFrame) -> dict[Pattern, int]:
    """How often each (kind, votes, length class) occurs: at most kinds x 3^5 x 4 rows."""
    one = marked.select(F.explode("spans").alias("s")).select("s.kind", "s.len", *[F.col(f"s.votes.{n}").alias(n) for n in LABELERS])
    rows = one.groupBy("kind", "len", *LABELERS).count().collect()
    return {(r["kind"], tuple(r[n] for n in LABELERS), r["len"]): r["count"] for r in rows}


START = {True: {1: 6.0, 0: 3.0, -1: 1.0}, False: {1: 1.0, 0: 3.0, -1: 6.0}}  # pseudo-counts keep votes' meaning


def reliabilities(counts: dict[Pattern, int], rounds: int = EM_ROUNDS) -> dict[Pattern, float]:
    """Posterior of each pattern by expectation-maximisation: labelers vote independently given the truth, with rates of their own for each kind.

    Each round estimates the rates of all kinds together, which lean on START, and each kind's own, which lean on those.
    """
    patterns = sorted(counts)
    kinds = sorted({p[0] for p in patterns})
    even = {truth: {v: n / 10 for v, n in start.items()} for truth, start in START.items()}
    rates = {kind: [even] * len(LABELERS) for kind in kinds}
    prior, posterior = dict.fromkeys(kinds, 0.7), {}

    def estimated(chosen: list[Pattern], labeler: int, lean: dict[bool, dict[int, float]], weight: float) -> dict[bool, dict[int, float]]:
        out = {}
        for truth in (True, False):
            sums = {v: weight * lean[truth][v] for v in (1, 0, -1)}
            for p in chosen:
                sums[p[1][labeler]] += counts[p] * (posterior[p] if truth else 1 - posterior[p])
            out[truth] = {v: n / sum(sums.values()) for v, n in sums.items()}
        return out

    for _ in range(rounds):
        for p in patterns:
            yes, no = math.log(prior[p[0]]), math.log(1 - prior[p[0]])
            for rate, v in zip(rates[p[0]], p[1], strict=True):
                yes, no = yes + math.log(rate[True][v]), no + math.log(rate[False][v])
            posterior[p] = 1 / (1 + math.exp(min(50, max(-50, no - yes))))
        shared = [estimated(patterns, j, even, 10) for j in range(len(LABELERS))]
        for kind in kinds:
            own = [p for p in patterns if p[0] == kind]
            rates[kind] = [estimated(own, j, shared[j], LEAN) for j in range(len(LABELERS))]
            good, whole = sum(counts[p] * posterior[p] for p in own), sum(counts[p] for p in own)
            prior[kind] = min(0.99, max(0.01, (good + 0.7 * LEAN) / (whole + LEAN)))
    return posterior


def _features(p: Pattern) -> list[str]:
    names = [f"{n}={v}" for n, v in zip(LABELERS, p[1], strict=True) if v]
    return ["bias", f"kind={p[0]}", f"len={p[2]}", *names, *[f"{p[0]}:{n}" for n in names]]


def train(counts: dict[Pattern, int], posterior: dict[Pattern, float], rounds: int = FIT_ROUNDS) -> dict[str, float]:
    """Weights of the logistic span classifier on the posteriors, patterns weighted by the root of their counts."""
    weights: dict[str, float] = {}
    rows = [(_features(p), posterior[p], math.sqrt(n)) for p, n in sorted(counts.items())]
    whole = sum(n for _, _, n in rows) or 1.0
    for _ in range(rounds):
        grad: dict[str, float] = {}
        for names, y, n in rows:
            score = sum(weights.get(f, 0.0) for f in names)
            miss = (y - 1 / (1 + math.exp(-max(-50.0, min(50.0, score))))) * n / whole
            for f in names:
                grad[f] = grad.get(f, 0.0) + miss
        for f, g in grad.items():
            weights[f] = weights.get(f, 0.0) * 0.9995 + 2.0 * g
    return weights


def accepted(weights: dict[str, float]) -> Column:
    """``spans`` without the added spans that the classifier rejects."""
    values = {"kind": lambda s: s["kind"], "len": lambda s: s["len"].cast("string")} | {n: (lambda s, n=n: s["votes"][n].cast("string")) for n in LABELERS}

    def keep(s: Column) -> Column:
        score = F.lit(weights.get("bias", 0.0))
        for f, w in sorted(weights.items()):
            if f == "bias":
                continue
            kind, _, vote = f.rpartition(":")
            name, _, value = vote.partition("=")
            if kind in BASE:
                continue  # base spans stay anyway
            holds = values[name](s) == value
            score = score + F.when(holds & (s["kind"] == kind) if kind else holds, w).otherwise(0.0)
        return s["base"] | (score >= math.log(THRESHOLD / (1 - THRESHOLD)))

    return F.filter("spans", keep)


def _spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans (how many) of every row."""
    marked = stash(with_spans(docs.select("doc_id", "text")).select("row.doc_id", "spans"), "pii-spans")
    counts = vote_patterns(marked)
    kept = marked.select("doc_id", "spans", accepted(train(counts, reliabilities(counts))).alias("kept"))
    base = F.filter("spans", lambda s: s["base"])
    return kept.select(
        "doc_id",
        *[F.size(F.filter("spans", _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in BASE],
        F.sha2(_spelled(base).cast("binary"), 256).alias("base_sha256"),
        _spelled(F.col("kept")).alias("spans"),
        F.size("kept").cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with each accepted span, or stretch of overlapping ones, replaced by its first kind in angle brackets; ``n_chars``, if there, is counted again.

    Rows and their spans are written once, so texts are searched once; the classifier learns from what was written.
    """
    marked = stash(with_spans(docs), "pii-marked")
    counts = vote_patterns(marked)
    text = F.col("row.text")

    def step(state: Column, s: Column) -> Column:
        inside = s["start"] < state["at"]
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(inside, state["out"]).otherwise(F.concat(state["out"], gap, F.lit("<"), s["kind"], F.lit(">"))).alias("out"))

    chosen = marked.select("row", accepted(train(counts, reliabilities(counts))).alias("spans"))
    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    written = chosen.select("row", F.when(F.size("spans") > 0, clean).otherwise(text).alias("clean"))
    columns = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(columns["n_chars"].isNotNull() & F.col("clean").isNotNull(), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return written.select(*[columns[c].alias(c) for c in docs.columns])
