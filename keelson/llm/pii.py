"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose candidate spans. Six labelers vote on each: format and checksum, gazetteers
(top-level domains, calling codes, card issuers, countries), words before it for and against,
what touches it, and its shape. How often each combination of votes and of features occurs over
all documents is a table of bounded size; expectation-maximisation on the votes estimates the
labelers' reliabilities, and a logistic span classifier over votes and features of the span (its
length, shares of digits and of capitals, changes between letters and digits) is trained on the
posterior labels. Candidates that it accepts and no base span overlaps are reported beside the
base spans, which are always reported. Work on a text grows with its length, or with the power
1.5 of the number of its candidates.

Defined results: null counts as empty: no spans; offsets count code points; repeated rows are
each reported; columns of other names pass through, those named like a result keep their names;
nothing is shuffled but the counts of votes and features.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import bind, cut, pieces, places, scan
from .common import fresh

#: Code points before a span that labelers look at.
BEFORE = 40
#: Kinds in order of report; the first four have base spans.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
VOTERS = ("format", "gazetteer", "context", "against", "touch", "shape")
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9 -]{11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}+",
}
#: What a text must have for a kind to be looked for.
GATE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "ssn": "[0-9]-[0-9]", "iban": "[A-Z]{2}[0-9]{2}", "secret": "[A-Za-z0-9_]{20}"}
#: Characters are exchanged one for one first, so that patterns need no nested repeats (they would
#: overflow the regex engine's stack on long inputs): dots that do not join two labels, and
#: separators that do not join two digits, become characters that end a match just there.
EXCHANGE = {"email": (r"\.(?![A-Za-z0-9-])|(?<![A-Za-z0-9-])\.", "%"), "card": (r"(?<![0-9])[ -]|[ -](?![0-9])", "#")}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

# Gazetteers and context words.
TLDS = "com|org|net|edu|gov|mil|int|info|biz|io|ai|app|dev|co|me|eu|us|uk|de|fr|es|it|nl|be|at|ch|pl|pt|se|no|dk|fi|ie|cz|gr|hu|ro|ru|ua|jp|cn|kr|in|br|mx|ar|cl|au|nz|ca|za|tr"
CALLING = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[1-9]|37[0-9]|38[0-9]|42[0-3]"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|3[68]"
COUNTRIES = "AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM|TR"
CONTEXT = {
    "email": "mail|contact|write to|reach|correo|courriel|kontakt",
    "ip": r"\bip\b|host|server|address|client|login",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": r"phone|\btel|call|fax|mobile|telefon|tél",
    "ssn": "ssn|social security",
    "iban": "iban|account|konto|compte|cuenta",
    "secret": "token|key|secret|passw|api|auth|bearer|credential",
}
AGAINST = r"version|isbn|order|invoice|serial|build|\bdoi|commit|hash|sha|md5|checksum"


def found(text: Column, kind: str) -> Column:
    """Matches of one kind in order, with what stands before and after them."""
    src = F.regexp_replace(text, *EXCHANGE[kind]) if kind in EXCHANGE else text
    gate = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(GATE[kind])
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,hit:string,before:string,after:string>>)")
    return F.when(gate, places(src, F.lit(PATTERN[kind]), F.length, BEFORE)).otherwise(none)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits has a right check digit."""

    def add(acc: Column, i: Column) -> Column:
        x = F.ascii(F.substring(d, F.length(d) - i, F.lit(1))) - 48
        return acc + F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0


def mod97(hit: Column) -> Column:
    """Whether an IBAN's check digits are right: its first four characters moved to the end, letters counted from 10, leave 1."""
    chars = F.split(F.regexp_replace(F.concat(F.substring(hit, 5, 60), F.substring(hit, 1, 4)), " ", ""), "")
    code = lambda c: F.ascii(c) - 48
    step = lambda acc, c: F.when(c == "", acc).when(code(c) < 10, (acc * 10 + code(c)) % 97).otherwise((acc * 100 + code(c) + 48 - 55) % 97)
    return F.aggregate(chars, F.lit(0), step) == 1


def valid(kind: str, hit: Column) -> Column:
    n = F.length(digits(hit))
    return {
        "email": F.lit(True),
        "ip": hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": F.when(n.between(12, 19), luhn(digits(hit))).otherwise(False),
        "phone": n.between(9, 15),
        "ssn": ~hit.rlike("^(?:000|666|9)|-00-|-0000$"),
        "iban": F.length(F.replace(hit, F.lit(" "), F.lit(""))).between(15, 34) & mod97(hit),
        "secret": hit.rlike("[0-9]") & hit.rlike("[A-Za-z]"),
    }[kind]


def votes(kind: str, x: Column, right: Column) -> Column:
    """The labelers' votes on a candidate: 1 for, 0 against, -1 none; right: whether it is valid."""
    hit, before, after = x["hit"], F.lower(x["before"]), x["after"]
    yes_no = lambda c: c.cast("int")
    or_none = lambda c, v: F.when(c, v).otherwise(-1)
    gazetteer = {
        "email": yes_no(F.lower(hit).rlike(rf"\.(?:{TLDS})$")),
        "ip": yes_no(~hit.rlike(r"^(?:0|10|127|255|192\.168)\.")),
        "card": yes_no(hit.rlike(f"^(?:{ISSUERS})")),
        "phone": yes_no(hit.rlike(rf"^\+(?:{CALLING})")),
        "ssn": F.lit(-1),
        "iban": yes_no(hit.rlike(f"^(?:{COUNTRIES})")),
        "secret": or_none(hit.rlike("^(?:AKIA|ghp_|gho_|sk_|pk_|xox|eyJ|AIza)"), 1),
    }[kind]
    shape = {
        "email": yes_no(hit.rlike("^[^@]*[A-Za-z]")),
        "ip": yes_no(~hit.rlike(r"(?:^|\.)0[0-9]")),
        "card": or_none(hit.rlike("^[0-9]{4}[ -][0-9]{4}[ -]|^[0-9]{13,19}$"), 1),
        "phone": or_none(hit.rlike("[ ().-]"), 1),
        "ssn": F.lit(1),
        "iban": or_none(hit.rlike("^[A-Z0-9]{4}(?: [A-Z0-9]{4})+|^[A-Z0-9]+$"), 1),
        "secret": yes_no(hit.rlike("^(?:[0-9a-f]{32,}|(?=.*[a-z])(?=.*[A-Z]).{20,})$")),
    }[kind]
    return F.array(
        yes_no(right),
        gazetteer,
        or_none(before.rlike(CONTEXT[kind]), 1),
        or_none(before.rlike(AGAINST), 0),
        yes_no(~(before.rlike(r"[\p{L}0-9]$") | after.rlike(r"^[\p{L}0-9]"))),
        shape,
    )


def features(hit: Column) -> Column:
    """Length, share of digits, share of capitals, and changes between letters and digits, each as a small number."""
    size = F.length(hit)
    share = lambda p: F.least(F.lit(LEVELS - 1), F.floor(LEVELS * (size - F.length(F.regexp_replace(hit, p, ""))) / size).cast("int"))
    return F.array(
        F.least(F.lit(LEVELS - 1), F.floor(F.log2(size.cast("double")) - 2).cast("int")),
        share("[0-9]"),
        share("[A-Z]"),
        F.least(F.lit(LEVELS - 1), F.regexp_count(hit, F.lit("[0-9][A-Za-z]"))),
    )


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with candidates: array<struct<start, ord, end, kind, base, free, votes, features>> in order of start, then kind.

    free: no base span overlaps it.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def of(kind: str, ordinal: int) -> Column:
        def make(x: Column) -> Column:
            return bind(
                valid(kind, x["hit"]),
                lambda right: F.struct(x["start"].alias("start"), F.lit(ordinal).alias("ord"), x["end"].alias("end"), F.lit(kind).alias("kind"), (right if ordinal < 4 else F.lit(False)).alias("base"), F.lit(True).alias("free"), votes(kind, x, right).alias("votes"), features(x["hit"]).alias("features")),
            )

        return F.transform(found(text, kind), make)

    def free(reach: Callable, overlaps: Callable) -> Callable:
        """A pass that marks candidates which a base span met before overlaps."""

        def step(far: Column, x: Column) -> Column:
            return F.struct(F.when(x["base"], reach(far, x)).otherwise(far).alias("state"), x.withField("free", x["free"] & ~overlaps(far, x)).alias("out"))

        return step

    def marked(every: Column) -> Column:
        onward = scan(every, F.lit(-1).cast("long"), free(lambda far, x: F.greatest(far, x["end"]), lambda far, x: far > x["start"]), ONE)
        back = scan(F.reverse(onward), F.lit((1 << 62)).cast("long"), free(lambda far, x: F.least(far, x["start"]), lambda far, x: far < x["end"]), ONE)
        mixed = F.exists(every, lambda x: x["base"]) & F.exists(every, lambda x: ~x["base"])
        return F.when(mixed, F.reverse(back)).otherwise(every)

    every = bind(F.array_sort(F.concat(*[of(k, i) for i, k in enumerate(KINDS)])), marked)
    return docs.withColumn(fresh("candidates", docs.columns), F.when(text.rlike("[0-9@]"), every).otherwise(F.expr(f"cast(array() as array<{ONE}>)")))


ONE = "struct<start:bigint,ord:int,end:bigint,kind:string,base:boolean,free:boolean,votes:array<int>,features:array<int>>"
#: Features of a span, and the values that each can take.
FEATURES, LEVELS = 4, 8


@dataclass(frozen=True)
class Model:
    bias: tuple[float, ...]  # by kind
    weights: tuple[float, ...]  # by labeler; a vote counts +1, -1 or 0
    reliability: tuple[tuple[float, float], ...]  # P(vote for | personal), P(vote against | not), of votes cast
    levels: tuple[tuple[float, ...], ...] = ()  # by feature and value

    def score(self, x: Column) -> Column:
        terms = [F.when(x["votes"][i] == 1, w).when(x["votes"][i] == 0, -w).otherwise(0.0) for i, w in enumerate(self.weights)]
        terms += [F.element_at(F.array(*map(F.lit, ws)), x["features"][i] + 1) for i, ws in enumerate(self.levels)]
        z = reduce(lambda a, b: a + b, terms, F.element_at(F.array(*map(F.lit, self.bias)), x["ord"] + 1))
        return 1 / (1 + F.exp(-z))


def fit(docs: DataFrame, col: str = "candidates", rounds: int = 40) -> Model:
    """Reliabilities by EM over all candidates' votes, then the span classifier on the posteriors.

    What is collected is the count of each (kind, votes, features): at most 7 x 3^6 x 8^4 rows
    whatever the input, some hundreds in texts.
    """
    rows = docs.select(F.explode(col).alias("c")).groupBy("c.ord", "c.votes", "c.features").agg(F.count("*").alias("n")).collect()
    rows.sort(key=lambda r: (r.ord, r.votes, r.features))
    kind = np.array([r.ord for r in rows], int)
    vote = np.array([r.votes for r in rows], int).reshape(-1, len(VOTERS))
    n = np.array([r.n for r in rows], float)
    kinds, cast, yes = np.eye(len(KINDS))[kind], vote >= 0, vote == 1
    prior = np.full(len(KINDS), 0.7)
    start = np.array([[0.3], [0.8]]) * np.ones(len(VOTERS))  # chance of a vote for, by class, if cast
    p = start.copy()
    post = np.full(len(rows), 0.5)
    for _ in range(rounds):
        like = np.where(cast, np.where(yes, p[:, None, :], 1 - p[:, None, :]), 1).prod(axis=2)
        like = like * np.stack([1 - prior[kind], prior[kind]])
        post = like[1] / like.sum(axis=0)
        prior = (7 + kinds.T @ (post * n)) / (10 + kinds.T @ n)
        mass = np.stack([(1 - post) * n, post * n])
        p = np.clip((10 * start + mass @ (cast & yes)) / (10 + mass @ cast), 0.01, 0.99)
        p[1] = np.maximum(p[1], p[0] + 0.01)  # a vote for never speaks against
    level = [np.eye(LEVELS)[np.array([r.features[i] for r in rows], int)].reshape(-1, LEVELS) for i in range(FEATURES)]
    x = np.concatenate([kinds, np.where(cast, np.where(yes, 1, -1), 0), *level], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's method with a ridge
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * q * (1 - q) + 1e-9)[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (q - post)) + w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    nk, nv = len(KINDS), len(VOTERS)
    return Model(tuple(w[:nk].tolist()), tuple(w[nk : nk + nv].tolist()), tuple(zip(p[1].tolist(), (1 - p[0]).tolist())), tuple(map(tuple, w[nk + nv :].reshape(FEATURES, LEVELS).tolist())))


def accepted(model: Model, every: Column, threshold: float = 0.5) -> Column:
    """Base candidates, and those that the classifier accepts and no base span overlaps."""
    return F.filter(every, lambda x: x["base"] | (x["free"] & (model.score(x) >= threshold)))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with accepted spans replaced by their kind in brackets; other texts stay as they are.

    Of spans that overlap, all characters go; what replaces them is the kind that begins first.
    """
    marked = candidates(docs, text_col)
    found_as = marked.columns[-1]
    spans_as = fresh("__spans", marked.columns)
    text, spans = F.col(text_col), F.col(spans_as)

    def step(parts: Column) -> Callable:
        def of(at: Column, x: Column) -> Column:
            instead = F.when(x["start"] < at, F.lit("")).otherwise(F.concat(cut(parts, at, x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
            return F.struct(F.greatest(at, x["end"]).alias("state"), instead.alias("out"))

        return of

    def masked(parts: Column) -> Column:
        done = F.array_join(scan(spans, F.lit(0).cast("long"), step(parts), "string"), "")
        last = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.concat(done, cut(parts, last, F.length(text).cast("long")))

    with_spans = marked.withColumn(spans_as, accepted(model, F.col(found_as)))
    return with_spans.withColumn(text_col, F.when(F.size(spans) > 0, bind(pieces(text), masked)).otherwise(text)).drop(found_as, spans_as)
