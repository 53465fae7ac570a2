"""Personal data: base patterns, and a weakly supervised span classifier over further candidates.

Candidate spans come from patterns.  For each, labelers vote yes (1), no (-1)
or abstain (0): pattern strictness, gazetteers, words around, and company in
the text.  Candidates are counted by their votes and features over the whole
table; expectation-maximisation on the votes estimates each labeler's
reliability, and its posteriors are the soft labels on which a logistic span
classifier learns from the span's features (shape, length, classes of
characters, what stands before and after, gazetteers, company), for each kind
of its own.  The counts are bounded by the number of labelers, features and
kinds, not by the data.  The classifier runs as a column expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataplane.llm.common import Scratch, let

#: Base kinds in order, as given.  Runs are possessive and start where a run starts, which finds
#: the same leftmost matches in linear time; a leading lookahead is there for speed only.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Gazetteers: honorifics and frequent given names, words that name a secret, values that only stand for one.
HONORIFICS = "Mr Mrs Ms Dr Prof Herr Frau Mme Monsieur Madame Señor Señora".split()
GIVEN_NAMES = "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Margaret Andrew Anna Peter Maria Paul Laura Hans Klaus Jürgen Ursula Sabine Pierre Jean Claude Camille Sophie José Juan Carmen Lucía Pablo Javier".split()
PLACEHOLDERS = "example|sample|changeme|placeholder|your[_-]|xxxx|0000|1234|dummy|test"

#: Kinds that only the method adds.
EXTRA = {
    "secret": r"(?i)\b(?:access[_-]?token|token|api[_-]?key|secret|passw(?:or)?d)\b[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?[A-Za-z0-9_+/=.-]{8,}[\"']?",
    "local_phone": r"(?=[(0-9])(?<![0-9+).-])(?<!\+[0-9]{1,3}[ .-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "national_id": r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "masked_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z0-9-]{2,63}){1,4}",
    "person": r"(?=[A-Z])(?<![\p{L}])(?:" + "|".join([h + r"\.?" for h in HONORIFICS] + GIVEN_NAMES) + r") \p{Lu}\p{Ll}{1,30}(?: \p{Lu}\p{Ll}{1,30})?(?![\p{L}])",
}
KINDS = [*BASE, *EXTRA]

#: Words near a candidate that speak for or against each kind; the last WINDOW characters before it are searched.
WINDOW = 48
CUES = {
    "email": (r"(?i)e-?mail|contact|write to|address", r"(?i)package|version"),
    "ip": (r"(?i)\bip\b|address|host|server|client", r"(?i)version|release|section|build|§"),
    "card": (r"(?i)card|visa|master|amex|credit|debit|payment|pan\b", r"(?i)order|isbn|serial|invoice|tracking|item"),
    "phone": (r"(?i)phone|tel|call|fax|mobile|contact", r"(?i)order|isbn|serial|invoice"),
    "secret": (r"(?i)secret|credential|auth|login|config|export", r"(?i)example|placeholder|sample"),
    "local_phone": (r"(?i)phone|tel\b|tel[.:]|call|fax|mobile|contact", r"(?i)order|isbn|serial|invoice|item|ref"),
    "national_id": (r"(?i)ssn|social|security|insurance|\bid\b", r"(?i)order|isbn|serial|invoice|item|ref|part"),
    "masked_email": (r"(?i)e-?mail|contact|write|reach", r"(?i)package"),
    "person": (r"(?i)name|dear|by\b|author|signed|contact|from|patient|customer", r"(?i)street|avenue|university|inc\b"),
}
LABELERS = ("strict", "gazetteer", "context", "company")
#: Yes or no facts of a candidate that the classifier learns from, as bits of a number, first fact lowest.
#: The votes on strictness and company are not among them: what they tell has to be learned from the span itself.
FEATURES = ("listed", "unlisted", "cued", "miscued", "long", "very_long", "digits", "lower", "upper", "marks", "after_sign", "after_word", "before_word")
#: Characters after a candidate that are looked at, matches summed at once for places, and counts that stand for nothing seen yet.
BEYOND, CHUNK, PRIOR = 24, 64, 1.0
#: Least probability at which the classifier adds a span.
THRESHOLD = 0.8


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    cells = F.reverse(F.split(digits, ""))
    parts = F.transform(cells, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.floor(d.cast("int") * 2 / 10).cast("int") + (d.cast("int") * 2) % 10))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    """Whether a base match is a base span."""
    if kind == "ip":
        return m.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _strict(kind: str, m: Column) -> Column:
    """The strictness labeler's vote."""
    yes = {
        "email": m.rlike(r"\.[A-Za-z]{2,24}$"),
        "ip": _valid("ip", m) & ~m.rlike(r"^0|\.0[0-9]"),
        "card": _valid("card", m),
        "phone": _valid("phone", m),
        "secret": m.rlike(r"[A-Za-z0-9_+/=-]{16,}") & m.rlike(r"[0-9]") & m.rlike(r"[A-Za-z]"),
        "local_phone": m.rlike(r"^\(?[2-9][0-9]{2}\)?[ .-]{1,2}[2-9]"),
        "national_id": ~m.rlike(r"^(?:000|666|9)|-00-|-0000$"),
        "masked_email": m.rlike(r"(?i)(?:dot[\])]|\.) ?[A-Za-z]{2,24}$"),
        "person": m.rlike(r" \p{Lu}\p{Ll}+"),
    }[kind]
    return F.when(yes, 1).otherwise(-1)


def _gazetteer(kind: str, m: Column) -> Column:
    if kind == "secret":
        return F.when(m.rlike("(?i)" + PLACEHOLDERS), -1).otherwise(1)
    if kind == "person":
        return F.when(m.rlike(r"^(?:" + "|".join(HONORIFICS) + r")\b"), 1).otherwise(0)
    if kind in ("email", "masked_email"):
        return F.when(m.rlike(r"(?i)(?:com|org|net|edu|gov|io|de|fr|es|uk)$"), 1).otherwise(0)
    if kind == "card":
        return F.when(m.rlike(r"^[3-6]"), 1).otherwise(-1)
    return F.lit(0)


def _running(sizes: Column) -> Column:
    """Sums of the elements before each place, in chunks, so the work stays far from quadratic."""

    def summed(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0), lambda a, x: a + x)

    def placed(x: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda c: summed(F.slice(x, c * CHUNK + 1, F.lit(CHUNK))))
        heads = let(chunks, lambda c: F.transform(c, lambda _, k: summed(F.slice(c, F.lit(1), k))))
        return let(heads, lambda h: F.transform(x, lambda _, i: F.get(h, F.shiftright(i, 6)) + summed(F.slice(x, F.shiftright(i, 6) * CHUNK + 1, i % CHUNK))))

    return let(sizes, lambda x: F.when(F.size(x) > 0, placed(x)).otherwise(F.array().cast("array<int>")))


def _matches(kind: str, text: Column) -> Column:
    """Array of (m, p, q, s): each leftmost match of the kind's pattern, the ends of the pieces before and after it, and its place in code points."""
    pattern = {**BASE, **EXTRA}[kind]
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))

    def rows(x: Column) -> Column:
        sizes = F.transform(x["found"], lambda m, i: F.length(F.get(x["pieces"], i)) + F.length(m))

        def one(m: Column, i: Column, before: Column) -> Column:
            piece = F.get(x["pieces"], i)
            return F.struct(m.alias("m"), F.substring(piece, -WINDOW, WINDOW).alias("p"), F.substring(F.get(x["pieces"], i + 1), 1, BEYOND).alias("q"), (F.get(before, i) + F.length(piece)).alias("s"))

        return let(_running(sizes), lambda before: F.transform(x["found"], lambda m, i: one(m, i, before)))

    empty = F.array().cast("array<struct<m:string,p:string,q:string,s:int>>")
    may = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike({"card": "[0-9][ -]?[0-9]", "secret": "[=:]", "masked_email": r"[\[(](?:at|AT)[\])]", "local_phone": "[0-9]{3}[ .-][0-9]{4}", "national_id": "[0-9]-[0-9]{2}-[0-9]"}.get(kind, pattern)))
    return F.when(may, let(both, rows)).otherwise(empty)


def candidates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, and an array column for each kind: structs of start, end, m, base, code (the votes in base 3), facts (the bits of FEATURES)."""
    names = [F.col(c) for c in keep]
    found = docs.select(*names, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t")).select(*keep, *[_matches(k, F.col("_t")).alias(f"_{k}") for k in KINDS])

    def based(k: str):
        return F.transform(f"_{k}", lambda x: F.struct(x["m"].alias("m"), x["p"].alias("p"), x["q"].alias("q"), x["s"].alias("s"), (_valid(k, x["m"]) if k in BASE else F.lit(False)).alias("base")))

    checked = found.select(*keep, *[based(k).alias(f"_{k}") for k in KINDS])
    some = F.lit(False)
    for k in BASE:
        some = some | F.exists(f"_{k}", lambda x: x["base"])
    checked = checked.withColumn("_some", some)

    def voted(k: str):
        def one(x):
            yes, no = CUES[k]
            context = F.when(x["p"].rlike(yes), 1).when(x["p"].rlike(no), -1).otherwise(0)
            company = F.when(F.col("_some"), 1).otherwise(0) if k in EXTRA else F.lit(0)
            votes = F.array(_strict(k, x["m"]), _gazetteer(k, x["m"]), context, company)
            return let(votes, lambda v: spanned(x, v))

        def spanned(x, v):
            code = F.aggregate(v, F.lit(0), lambda a, y: a * 3 + (y + 1))
            m, get = x["m"], lambda i: F.get(v, F.lit(i))
            facts = [get(1) > 0, get(1) < 0, get(2) > 0, get(2) < 0, F.length(m) >= 12, F.length(m) >= 20, m.rlike("[0-9]"), m.rlike(r"\p{Ll}"), m.rlike(r"\p{Lu}"), m.rlike(r"[^\p{L}0-9\s]"), x["p"].rlike(r"[:=#(\"'] ?$"), x["p"].rlike(r"\p{Ll}\.? $"), x["q"].rlike(r"^ ?\p{L}")]
            bits = F.lit(0)
            for i, fact in enumerate(facts):
                bits = bits + F.when(fact, 1 << i).otherwise(0)
            return F.struct(x["s"].alias("start"), (x["s"] + F.length(m)).alias("end"), m.alias("m"), x["base"].alias("base"), code.alias("code"), bits.alias("facts"))

        return F.transform(f"_{k}", one)

    return checked.select(*keep, *[voted(k).alias(k) for k in KINDS])


@dataclass(frozen=True)
class Model:
    """Reliability of each labeler, prior of each kind, and the classifier: bias and a weight a feature, by kind."""

    reliability: dict[str, float]
    prior: dict[str, float]
    classifier: dict[str, list[float]]

    def accepts(self, kind: str, facts: int) -> bool:
        bias, *weights = self.classifier[kind]
        return bias + sum(w for i, w in enumerate(weights) if facts >> i & 1) >= log(THRESHOLD / (1 - THRESHOLD))


def _votes(code: int) -> list[int]:
    out = []
    for _ in LABELERS:
        out.append(code % 3 - 1)
        code //= 3
    return out[::-1]


def _logistic(x: np.ndarray, want: np.ndarray, n: np.ndarray, start: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights (bias first) of a logistic regression on soft labels ``want`` that count ``n`` times, by Newton steps with a ridge of PRIOR around ``start``."""
    x = np.column_stack([np.ones(len(x)), x])
    w = start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - want)) + PRIOR * (w - start)
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + PRIOR * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
    return w


def fit_counts(counts: dict[tuple[str, int, int], int], rounds: int = 50) -> Model:
    """EM over counted votes, then a logistic regression of its posteriors on the facts, for each kind.

    Keys are (kind, votes, facts).  A span's label comes from its votes, its
    features are its facts, so spans of equal votes may be told apart.  With no
    candidates the labelers keep their prior reliability of 0.8, and a kind
    without candidates accepts nothing.
    """
    keys = sorted(counts)
    votes = np.array([_votes(c) for _, c, _ in keys]).reshape(len(keys), len(LABELERS))
    n = np.array([counts[k] for k in keys], dtype=float)
    kind = np.array([KINDS.index(k) for k, _, _ in keys], dtype=int)
    facts = np.array([[f >> i & 1 for i in range(len(FEATURES))] for _, _, f in keys], dtype=float).reshape(len(keys), len(FEATURES))
    right = np.full(len(LABELERS), 0.8)
    prior = np.full(len(KINDS), 0.5)
    post = np.zeros(len(keys))
    for _ in range(rounds if len(keys) else 0):
        score = np.log(prior / (1 - prior))[kind] + votes @ np.log(right / (1 - right))
        post = 1 / (1 + np.exp(-score))
        for i in range(len(LABELERS)):
            agree = n * np.where(votes[:, i] > 0, post, 1 - post) * (votes[:, i] != 0)
            right[i] = np.clip((agree.sum() + 8) / ((n * (votes[:, i] != 0)).sum() + 10), 0.55, 0.99)
        for k in range(len(KINDS)):
            prior[k] = np.clip(((n * post)[kind == k].sum() + 5) / (n[kind == k].sum() + 10), 0.05, 0.95)
    listed, cued = np.log(right / (1 - right))[1:3]
    classifier = {}
    for k, name in enumerate(KINDS):
        own = kind == k
        if not own.any():
            classifier[name] = [0.0] * (1 + len(FEATURES))
            continue
        mean = np.clip((n * post)[own].sum() / n[own].sum(), 1e-4, 1 - 1e-4)
        start = np.array([np.log(mean / (1 - mean)), listed, -listed, cued, -cued] + [0.0] * (len(FEATURES) - 4))
        classifier[name] = _logistic(facts[own], post[own], n[own], start).tolist()
    return Model(dict(zip(LABELERS, right.tolist(), strict=True)), dict(zip(KINDS, prior.tolist(), strict=True)), classifier)


def fit(found: DataFrame) -> Model:
    """Counts the votes and facts of all candidates (as from ``candidates``) and fits the model on the counts."""

    def coded(k: str):
        return F.transform(k, lambda x: F.struct(F.lit(k).alias("kind"), x["code"].alias("code"), x["facts"].alias("facts")))

    rows = found.select(F.explode(F.flatten(F.array(*[coded(k) for k in KINDS]))).alias("x")).groupBy("x.kind", "x.code", "x.facts").count().collect()
    return fit_counts({(r[0], r[1], r[2]): r[3] for r in rows})


def _acceptor(model: Model, kind: str):
    """A filter on candidates of a kind: base spans and those that the classifier adds."""
    bias, *weights = model.classifier[kind]

    def score(facts: Column) -> Column:
        out = F.lit(float(bias))
        for i, w in enumerate(weights):
            out = out + F.when(facts.bitwiseAND(1 << i) > 0, float(w)).otherwise(0.0)
        return out

    return lambda x: x["base"] | (score(x["facts"]) >= log(THRESHOLD / (1 - THRESHOLD)))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans), a row for each row of ``docs``.

    A null text counts as empty.  Base spans stand as found; added spans are
    the candidates that the classifier accepts, and come after the base kinds
    where their kind is not a base kind.
    """
    got = Scratch(docs.sparkSession, "pii").save(candidates(docs.select("doc_id", "text")))
    model = fit(got)

    def spans(k: str, keep) -> Column:
        return F.transform(F.filter(k, keep), lambda x: F.concat_ws(":", F.lit(k), x["start"], x["end"]))

    base = F.concat(*[spans(k, lambda x: x["base"]) for k in BASE])
    every = F.concat(*[spans(k, _acceptor(model, k)) for k in KINDS])
    sized = got.select("doc_id", *[F.size(F.filter(k, lambda x: x["base"])).cast("long").alias(f"n_{k}") for k in BASE], base.alias("_b"), every.alias("_e"))
    return sized.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(F.array_join("_b", ","), 256).alias("base_sha256"), F.array_join("_e", ",").alias("spans"), (F.size("_e") - F.size("_b")).cast("long").alias("n_added"), F.size("_e").cast("long").alias("n_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each accepted span of text replaced by its kind in brackets; a null text stays null.

    Of overlapping spans the first stands and takes the others in.  Texts are
    cut in a fixed-width encoding, so the time is linear in their length.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").cast("string").alias("text"))
    got = Scratch(docs.sparkSession, "pii").save(candidates(row, keep=("_row",)))
    model = fit(got)

    def tagged(k: str):
        return F.transform(F.filter(k, _acceptor(model, k)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("tag")))

    got = got.select("_row", F.sort_array(F.concat(*[tagged(k) for k in KINDS])).alias("_s"))
    none = F.array().cast("array<struct<a:int,b:int,tag:string>>")
    cuts = F.aggregate(
        "_s",
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), x["start"].alias("b"), x["tag"].alias("tag"))))).otherwise(acc["out"]).alias("out"),
        ),
    )
    got = got.withColumn("_c", cuts).withColumn("_u", F.when(F.size("_s") > 0, F.encode("_row.text", "UTF-32")))

    def cut(a, b):
        part = F.substring(F.col("_u"), a * 4 + 1, (b - a) * 4)
        text = F.decode(part, "UTF-32")
        return F.when(F.substring(part, 1, 4) == F.unhex(F.lit("0000FEFF")), F.concat(F.lit("\ufeff"), text)).otherwise(text)

    size = (F.octet_length("_u") / 4).cast("int")
    body = F.array_join(F.transform("_c.out", lambda x: F.concat(cut(x["a"], x["b"]), x["tag"])), "")
    text = F.when(F.size("_s") > 0, F.concat(body, cut(F.col("_c.at"), size))).otherwise(F.col("_row.text"))
    return got.select(*[text.alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
