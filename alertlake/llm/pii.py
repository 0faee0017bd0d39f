"""Personal data by weak supervision: labelers vote on spans, expectation-maximisation weighs them.

Candidates are the matches of the base patterns and of looser ones (written-out addresses, national
numbers, IPv6, grouped cards, names after titles, identity numbers, accounts). Pattern, checksum,
gazetteer and context labelers vote for or against each, or abstain. The counts of equal votes over
all texts, a table bounded by the number of labelers, are all that expectation-maximisation reads;
it estimates how often each labeler is right, and with that how likely each vote pattern is personal
data. A logistic classifier learnt from these likelihoods decides which loose candidates count.
Everything that touches texts or candidates is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertlake.session import written

KINDS = ("email", "ip", "card", "phone", "name", "national_id", "account")
BASE_KINDS = KINDS[:4]
# Leftmost matches as the base asks for. Look-behinds and possessive repeats only keep a long run
# without a match from being tried again from each of its characters.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:\(at\)|\[at\]|\{at\}|<at>|\(@\)|\[@\])", r"(?:\(dot\)|\[dot\]|\{dot\}|<dot>)"
LOOSE = {
    "email": rf"(?i)(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?{_AT}\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?{_DOT}\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}([\x20./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}+)(?![0-9])",
    "phone": r"(?<![\p{L}0-9+().-])(?<![0-9][\x20])(?:\([0-9]{2,5}\)[\x20.-]?|[0-9]{2,5}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![\x20.-]?[0-9])",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.?\x20\p{Lu}[\p{L}'-]{1,40}(?:\x20\p{Lu}[\p{L}'-]{1,40})?",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
}
TOP_DOMAINS = (
    "com org net edu gov mil int info biz io ai app dev co me tv eu de fr es it nl be at ch pl se no dk fi pt gr cz hu ro ie uk us ca "
    "mx br ar cl au nz jp cn kr in ru ua tr il za sg hk tw"
).split()
CALLING_CODES = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 "
    "420 421 380 852 886 971 972"
).split()
ACCOUNT_COUNTRIES = "AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split()
FIRST_NAMES = (
    "James Mary John Robert Patricia Michael Linda William David Elizabeth Richard Susan Joseph Jessica Thomas Sarah Charles Karen Anna Peter "
    "Maria Hans Klaus Ursula Jürgen Sabine Stefan Monika Andreas Petra Jean Marie Pierre Michel Philippe Nathalie Isabelle Nicolas Sophie Luc "
    "José Carmen Antonio Manuel Ana Francisco Laura Juan Carlos Lucía Pedro Elena Miguel Isabel Alice Emma Paul George Helen Laura"
).split()
CUES = {
    "email": r"(?i)e-?mail|mail|contact|write|reach|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|address|host|server|client|from|login|adresse",
    "card": r"(?i)card|visa|master|amex|credit|payment|pay|karte|carte|tarjeta",
    "phone": r"(?i)phone|call|tel|fax|mobile|cell|contact|ruf|appel|llam|móvil",
    "name": r"(?i)\bby\b|dear|from|contact|regards|signed|liebe|cher|querid",
    "national_id": r"(?i)ssn|social|security|\bid\b|ident",
    "account": r"(?i)iban|account|konto|bank|compte|cuenta",
}
DECOYS = r"(?i)version|release|build|isbn|issn|order|invoice|token|serial|hash|commit|page|section|chapter|figure|table|sku|part no|ratio|score"
LABELERS = ("shape", "check", "gazetteer", "cue", "decoy", "edge")
CONTEXT = 40
ROUNDS = 50
MIN_SCORE = 0.5


def _vote(holds: Column, against: int = -1) -> Column:
    return F.when(holds, 1).otherwise(against)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of 13 to 19 digits is right; false for other lengths."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == 1
        return total + F.when(~twice, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0).otherwise(False)


def bytes_of_ip(text: Column) -> Column:
    """Whether no part of dotted numbers is over 255, leading zeros aside."""
    parts = F.transform(F.split(text, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    return F.forall(parts, lambda x: (F.length(x) <= 3) & (F.left(x, F.lit(3)).cast("int") <= 255))


def mod97(text: Column) -> Column:
    """Whether an account number's check digits are right."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.left(plain, F.lit(4)))

    def step(rest: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, ch: F.when(ch == "", rest).otherwise(step(rest, ch))) == 1


@dataclass(frozen=True)
class Labels:
    """Columns of the first three votes on a span's text; the others are alike for all kinds."""

    shape: Column
    check: Column
    gazetteer: Column


def labels(kind: str, t: Column) -> Labels:
    digits = _digits(t)
    n = F.length(digits)
    if kind == "email":
        top = F.lower(F.regexp_extract(t, "([A-Za-z0-9-]+)$", 1))
        return Labels(_vote(t.rlike("[.)}\\]> ][A-Za-z]{2,24}$")), _vote(~t.rlike(r"\.\.|^\.|\.@|@-|-\.|-$")), _vote(top.isin(TOP_DOMAINS)))
    if kind == "ip":
        v6 = t.contains(":")
        full = F.when(v6, t.rlike(r"::|(?:[0-9A-Fa-f]{1,4}:){7}")).otherwise(~t.rlike(r"(?:^|\.)0[0-9]"))
        valid = F.when(v6, ~t.rlike("::.*::|^:[^:]")).otherwise(bytes_of_ip(t))
        return Labels(_vote(full), _vote(valid), _vote(~t.rlike(r"^(?:0|127|255)\.|^::1?$"), -1))
    if kind == "card":
        return Labels(_vote((n == 16) | ((n == 15) & digits.startswith("3")), 0), _vote(luhn(digits)), _vote(digits.rlike("^(?:3[47]|4|5[1-5]|2[2-7]|6)")))
    if kind == "phone":
        code = F.when(t.startswith("+"), F.exists(F.array(*[F.lit(c) for c in CALLING_CODES]), lambda c: digits.startswith(c)))
        return Labels(_vote(n.between(10, 12)), _vote(n.between(9, 15)), F.coalesce(_vote(code), F.lit(0)))
    if kind == "name":
        first = F.regexp_extract(t, r" (\p{Lu}[\p{L}'-]*)", 1)
        return Labels(_vote(t.rlike(r" \S+ \S"), 0), F.lit(0), _vote(first.isin(FIRST_NAMES)))
    if kind == "national_id":
        return Labels(F.lit(1), _vote(~t.rlike("^(?:000|666|9)|-00-|-0000$")), F.lit(0))
    return Labels(F.lit(1), _vote(mod97(t)), _vote(F.left(t, F.lit(2)).isin(ACCOUNT_COUNTRIES)))


def running(sizes: Column) -> Column:
    """Sums of what stands before each item, in blocks of about the root of their number."""
    side = F.greatest(F.ceil(F.sqrt(F.size(sizes))).cast("int"), F.lit(1))
    starts = F.sequence(F.lit(0), F.greatest(F.size(sizes) - 1, F.lit(0)), side)
    blocks = F.transform(starts, lambda b: F.slice(sizes, b + 1, side))

    def sums(items: Column) -> Column:
        none = F.struct(F.array().cast("array<bigint>").alias("l"), F.lit(0).cast("bigint").alias("s"))
        step = lambda a, x: F.struct(F.concat(a["l"], F.array(a["s"])).alias("l"), (a["s"] + x).alias("s"))
        return F.aggregate(items, none, step, lambda a: a["l"])

    heads = sums(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, x: s + x)))
    return F.flatten(F.zip_with(F.transform(blocks, sums), heads, lambda l, h: F.transform(l, lambda x: x + h)))


def candidates(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, found): spans with kind, order, start, end, text, base, valid, their votes and colon.

    Each step stands behind a generated row, so that no expression is worked out per span.
    """
    c = F.col
    patterns = [(k, True, BASE[k]) for k in BASE_KINDS] + [(k, False, LOOSE[k]) for k in KINDS]
    rows = docs.select(c(f"`{id}`").alias("id"), F.coalesce(c(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    matches = [F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(f"m{i}") for i, (_, _, p) in enumerate(patterns)]
    rows = rows.select("id", "t", F.inline(F.array(F.struct(*matches))))

    def between(i: int, pattern: str) -> Column:
        part = lambda x: F.struct(F.length(x).alias("n"), F.right(x, F.lit(CONTEXT)).alias("b"), F.left(x, F.lit(1)).alias("a"))
        return F.when(F.size(f"m{i}") > 0, F.transform(F.split("t", pattern, -1), part)).alias(f"z{i}")

    ms = [f"m{i}" for i in range(len(patterns))]
    rows = rows.select("id", *ms, F.inline(F.array(F.struct(*[between(i, p) for i, (_, _, p) in enumerate(patterns)]))))

    def sizes(i: int) -> Column:
        return F.transform(f"z{i}", lambda z, k: z["n"] + F.coalesce(F.length(F.get(f"m{i}", k)), F.lit(0))).alias(f"l{i}")

    zs = [f"z{i}" for i in range(len(ms))]
    rows = rows.select("id", *ms, *zs, F.inline(F.array(F.struct(*[sizes(i) for i in range(len(ms))]))))
    starts = [F.when(c(f"l{i}").isNotNull(), running(c(f"l{i}"))).alias(f"s{i}") for i in range(len(ms))]
    rows = rows.select("id", *ms, *zs, F.inline(F.array(F.struct(*starts))))

    def spans(i: int, kind: str, base: bool) -> Column:
        def one(m: Column, k: Column) -> Column:
            before, after = F.get(f"z{i}", k)["b"], F.get(f"z{i}", k + 1)["a"]
            start = F.get(f"s{i}", k) + F.get(f"z{i}", k)["n"]
            votes = labels(kind, m)
            inside = before.rlike(r"[\p{L}\p{N}]$") | after.rlike(r"^[\p{L}\p{N}]")
            given = {
                "shape": votes.shape, "check": votes.check, "gazetteer": votes.gazetteer,
                "cue": F.when(before.rlike(CUES[kind]), 1).otherwise(0), "decoy": F.when(before.rlike(DECOYS), -1).otherwise(0), "edge": _vote(~inside),
            }
            return F.struct(
                F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("order"), start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text"),
                F.lit(base).alias("base"), (F.lit(True) if base and kind == "email" else given["check"] == 1 if base else given["check"] >= 0).alias("valid"),
                F.concat_ws(",", *[given[name].cast("string") for name in LABELERS]).alias("votes"), before.rlike("[:=] ?$").alias("colon"),
            )

        return F.when(F.size(f"m{i}") > 0, F.transform(f"m{i}", one))

    arrays = [F.coalesce(spans(i, kind, base), F.array().cast(_SPANS)) for i, (kind, base, _) in enumerate(patterns)]
    return rows.select("id", F.concat(*arrays).alias("found"))


_SPANS = "array<struct<kind:string,order:int,start:bigint,end:bigint,text:string,base:boolean,valid:boolean,votes:string,colon:boolean>>"


@dataclass
class Model:
    """Reliabilities (labeler: share of right votes) and the classifier's weights."""

    reliability: dict[str, float]
    weights: dict[tuple[str, str], float]
    bias: float


def likelihoods(counts: list[tuple[str, str, int]], rounds: int = ROUNDS) -> tuple[np.ndarray, dict[str, float]]:
    """How likely the spans of each row (kind, votes, count) are personal data, by EM.

    Labelers are independent given the truth, votes have a chance of their own for either truth,
    kinds a share of true spans. It starts from the majority of votes.
    """
    votes = np.array([[int(v) for v in pattern.split(",")] for _, pattern, _ in counts], np.int64).reshape(-1, len(LABELERS))
    kinds = np.array([KINDS.index(k) for k, _, _ in counts], np.int64)
    n = np.array([c for _, _, c in counts], np.float64)
    true = np.where(votes.sum(axis=1) > 1, 0.9, 0.1)
    chance = np.zeros((2, len(LABELERS), 3))
    for _ in range(rounds):
        for z, share in enumerate((1 - true, true)):
            for j in range(len(LABELERS)):
                seen = np.bincount(votes[:, j] + 1, weights=n * share, minlength=3) + 0.5
                chance[z, j] = seen / seen.sum()
        prior = (np.bincount(kinds, weights=n * true, minlength=len(KINDS)) + 1) / (np.bincount(kinds, weights=n, minlength=len(KINDS)) + 2)
        logs = [np.log(chance[z][np.arange(len(LABELERS)), votes + 1]).sum(axis=1) for z in (0, 1)]
        odds = np.log(prior[kinds]) - np.log(1 - prior[kinds]) + logs[1] - logs[0]
        true = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    said = {name: (n[votes[:, j] > 0] @ true[votes[:, j] > 0] + n[votes[:, j] < 0] @ (1 - true[votes[:, j] < 0])) / max(n[votes[:, j] != 0].sum(), 1)
            for j, name in enumerate(LABELERS)} if len(counts) else {}
    return true, said


def _features(kind: str, votes: str, colon: bool) -> list[tuple[str, str]]:
    named = [(name, v) for name, v in zip(LABELERS, votes.split(",")) if v != "0"]
    return [("kind", kind), *named, *([("colon", "1")] if colon else [])]


def train(counts: list[tuple[str, str, bool, int]]) -> Model:
    """The classifier: ridge logistic regression on the likelihoods, by Newton steps."""
    rows = [(k, v, n) for k, v, _, n in counts]
    true, reliability = likelihoods(rows)
    names = sorted({f for k, v, colon, _ in counts for f in _features(k, v, colon)})
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(counts), len(names) + 1))
    x[:, -1] = 1
    for r, (k, v, colon, _) in enumerate(counts):
        x[r, [place[f] for f in _features(k, v, colon)]] = 1
    n, w = np.array([c for *_, c in counts], np.float64), np.zeros(len(names) + 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - true)) + w
        w -= np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), slope)
    return Model(reliability, dict(zip(names, w[:-1].tolist())), float(w[-1]))


def score(model: Model, span: Column) -> Column:
    """The classifier's probability that a span is personal data."""
    given = F.split(span["votes"], ",")
    total = F.lit(model.bias)
    for (name, value), weight in model.weights.items():
        holds = span["kind"] == value if name == "kind" else span["colon"] if name == "colon" else given[LABELERS.index(name)] == value
        total = total + F.when(holds, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def pii_spans(docs: DataFrame, text: str = "text", id: str = "doc_id", min_score: float = MIN_SCORE) -> tuple[DataFrame, Model]:
    """((id, spans) of every row, the fitted model); spans: kind, order, start, end, text, base, score.

    Base spans are valid matches of the base patterns and stay whatever their score. Loose
    candidates are added if their checksum does not fail, the classifier gives them min_score or
    more, they overlap no base span and begin after all added spans before them have ended. Places
    are code points, ends exclusive. Null, empty and other texts without a candidate have an empty
    list. Rows that share an id, or have none, each get their own result; other columns are not
    read. Context is what stands within 40 characters before a match and after the match before it.
    """
    c = F.col
    # Row numbers are written, so that they stay what they are when a task is repeated.
    found = written(candidates(docs, text, id).withColumn("n", F.monotonically_increasing_id()), "pii-candidates")
    counted = found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.votes", "x.colon").count()
    # At most one row for each kind and way to vote: 7 * 3^6 * 2.
    model = train(sorted((r["kind"], r["votes"], r["colon"], r["count"]) for r in counted.collect()))
    scored = F.transform("found", lambda x: F.struct(*[x[f].alias(f) for f in ("kind", "order", "start", "end", "text", "base")], x["valid"].alias("valid"), score(model, x).alias("score")))
    likely = F.filter(scored, lambda x: x["valid"] & (x["base"] | (x["score"] >= min_score)))
    rows = found.select("id", "n", F.inline(F.array(F.struct(likely.alias("spans")))))
    base = F.filter("spans", lambda x: x["base"])
    # Only texts with loose spans to add are looked at span by span.
    more = rows.filter(F.exists("spans", lambda x: ~x["base"])).select("n", F.explode("spans").alias("x"))
    by_place = Window.partitionBy("n").orderBy("x.start", c("x.base").desc(), c("x.end").desc(), "x.order")
    before = by_place.rowsBetween(Window.unboundedPreceding, -1)
    after = by_place.rowsBetween(1, Window.unboundedFollowing)
    apart = F.coalesce(F.max("x.end").over(before), F.lit(0)) <= c("x.start")
    clear = F.coalesce(F.min(F.when(c("x.base"), c("x.start"))).over(after) >= c("x.end"), F.lit(True))
    kept = more.select("n", "x", (apart & clear).alias("free")).filter("free and not x.base").groupBy("n").agg(F.collect_list("x").alias("added"))
    joined = rows.join(kept, "n", "left")
    spans = F.when(c("added").isNull(), base).otherwise(F.concat(base, "added"))
    order = lambda a, b: F.when(a["order"] != b["order"], F.when(a["order"] < b["order"], -1).otherwise(1)).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)
    return joined.select("id", F.when(c("added").isNull(), base).otherwise(F.array_sort(spans, order)).alias("spans")), model


def digests(found: DataFrame) -> DataFrame:
    """Counts and places of each row's spans; base spans come by kind, then start, as do all."""
    mine = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("bigint").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select(
        F.col("id").alias("doc_id"), *[mine(k) for k in BASE_KINDS], F.sha2(listed(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
