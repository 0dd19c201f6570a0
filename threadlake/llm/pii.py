"""Personal data by candidate boosting, in DataFrame expressions only.

High-recall patterns propose spans, which may overlap. Each candidate gets
format features (lengths, digit shares, check digits) and context features (the
words before it, the characters beside it). Boosted trees, fitted on generated
examples and compiled to a column expression, score the candidates; a
threshold for each kind, calibrated on held-out examples, selects. Candidates
of the base patterns that pass their checks (the base spans) always stay.

Matching, features, scores and redaction all run inside the JVM. A pattern's
matches are set between marker characters, so one split gives every match with
its code-point offsets.

Edge cases: a null text counts as empty; texts without candidates have no
spans and the digest of the empty string; equal rows get equal spans; an empty
table gives no rows; other columns pass through ``spans`` and ``redact``;
quantifiers are possessive where that changes no match, so very long runs cost
linear time and no stack.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm.common import fresh, let

MARK, OTHER = "\u0001", "\u0002"
#: Kinds in the order of the digests; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")
#: The base patterns. \G and the look-behinds only avoid starting again inside a run that has failed.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further proposals; they overlap the base ones and each other.
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{2,63}+(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,24}){1,3}",
    "phone": r"(?<![0-9+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|(?: ?[A-Z0-9]{4}){2} ?[A-Z0-9]{3})(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{24,}+(?![A-Za-z0-9_/+-])",
}
CONTEXT = 24
HINTS = r"(?i)(?:mail|contact|phone|tel|call|fax|mobile|card|visa|iban|bank|account|ssn|social|key|token|secret|passw|api|auth|[=:\"'] ?$)"
FEATURES = ("kind", "chars", "digits", "uppers", "lowers", "marks", "digit_share", "checks", "base", "hint", "glued", "words")
#: Values of a block in running sums; characters of a piece in redaction; more than any place in a text.
BLOCK, PIECE, FAR = 256, 256, 1 << 40
LONG = "long"


def _running(values: Column, join) -> Column:
    """``join`` of all values before each place, and of all at the end; of none it is 0.

    In blocks, so that no array grows value by value: linear but for the one short array of the blocks' ends.
    """
    zero = F.lit(0).cast(LONG)
    last = lambda a: F.element_at(a, -1)
    grow = lambda part: F.aggregate(part, F.array(zero), lambda a, x: F.concat(a, F.array(join(last(a), x))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: grow(F.slice(values, b * BLOCK + 1, BLOCK)))

    def whole(inner: Column) -> Column:
        def shifted(before: Column) -> Column:
            parts = F.transform(inner, lambda a, k: F.transform(F.slice(a, 1, F.size(a) - 1), lambda x: join(F.get(before, k), x)))
            return F.concat(F.flatten(parts), F.array(last(before)))

        return let(grow(F.transform(inner, last)), shifted)

    return F.when(F.size(values) > 0, let(blocks, whole)).otherwise(F.array(zero))


def _sums(lens: Column) -> Column:
    return _running(lens, lambda a, x: a + x)


def _largest(values: Column) -> Column:
    return _running(values, lambda a, x: F.greatest(a, x))


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, before, after>> of all matches; ``text`` holds no marker."""

    def cut(parts: Column) -> Column:
        lens = F.transform(parts, lambda p: F.length(p).cast(LONG))

        def place(starts: Column) -> Column:
            def one(i: Column) -> Column:
                k = 2 * i - 1
                value = F.get(parts, k)
                return F.struct(
                    F.get(starts, k).alias("start"),
                    F.get(starts, k + 1).alias("end"),
                    value.alias("value"),
                    F.right(F.get(parts, k - 1), F.lit(CONTEXT)).alias("before"),
                    F.left(F.get(parts, k + 1), F.lit(1)).alias("after"),
                )

            return F.transform(F.sequence(F.lit(1), F.floor((F.size(parts) - 1) / 2).cast("int")), one)

        return F.when(F.size(parts) >= 3, let(let(lens, _sums), place))

    return let(F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1), cut)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string holds (Luhn)."""

    def term(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


def _mod97(value: Column) -> Column:
    """Whether an account number's remainder is 1 (two check digits)."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))

    def step(a: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _checks(kind: str, value: Column) -> Column:
    """The format check of a kind."""
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "ssn":
        return ~value.rlike(r"^(?:000|666|9..)|-00-|-0000$")
    if kind == "iban":
        return _mod97(value)
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


def _features(kind: str, base: bool, m: Column) -> Column:
    """One candidate: its span, kind, whether it is a base span, and its features."""
    v = m["value"]
    count = lambda cls: F.length(F.regexp_replace(v, f"[^{cls}]", ""))
    number = lambda c: c.cast("double")

    def build(checks: Column) -> Column:
        glued = F.coalesce(F.right(m["before"], F.lit(1)).rlike("[A-Za-z0-9]"), F.lit(False)) | F.coalesce(m["after"].rlike("[A-Za-z0-9]"), F.lit(False))
        found = {
            "kind": F.lit(float(KINDS.index(kind))),
            "chars": number(F.length(v)),
            "digits": number(count("0-9")),
            "uppers": number(count("A-Z")),
            "lowers": number(count("a-z")),
            "marks": number(F.length(F.regexp_replace(v, "[A-Za-z0-9 ]", ""))),
            "digit_share": number(count("0-9")) / number(F.length(v)),
            "checks": number(checks),
            "base": F.lit(float(base)),
            "hint": number(m["before"].rlike(HINTS)),
            "glued": number(glued),
            "words": number(F.size(F.split(v, r"[^A-Za-z]+"))),
        }
        return F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), (F.lit(base) & checks).alias("base"), F.struct(*(found[n].alias(n) for n in FEATURES)).alias("x")
        )

    return let(_checks(kind, v), build)


def _describe(kind: str, base: bool):
    return lambda m: _features(kind, base, m)


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


CANDIDATE = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,x:struct<" + ",".join(f"{n}:double" for n in FEATURES) + ">>>"


def candidates(text: Column) -> Column:
    """All proposals for a text, by kind as listed, the base pattern's first, then by start."""
    none = F.lit(None).cast(CANDIDATE)
    digit, long_run = text.rlike("[0-9]"), text.rlike("[A-Za-z0-9_/+-]{24}")
    worth = {
        ("email", True): F.contains(text, F.lit("@")), ("email", False): text.rlike(r"[\[(]at[\])]"),
        ("ip", True): text.rlike(r"[0-9]\.[0-9]"), ("card", True): text.rlike("[0-9][ -]?[0-9]"), ("phone", True): text.rlike(r"\+[0-9]"),
        ("phone", False): text.rlike("[0-9][ .-][0-9]{4}"), ("ssn", False): text.rlike("[0-9]-[0-9]{2}-[0-9]"), ("iban", False): text.rlike("[A-Z]{2}[0-9]{2}"), ("secret", False): long_run,
    }
    found = []
    for kind in KINDS:
        for base, patterns in ((True, BASE), (False, MORE)):
            if kind in patterns:
                one = F.transform(_matches(text, patterns[kind]), _describe(kind, base))
                found.append(F.coalesce(F.when((worth[kind, base] if kind == "email" or kind == "secret" else digit & worth[kind, base]), one).cast(CANDIDATE), F.array().cast(CANDIDATE)))
    return F.coalesce(F.concat(*found), none)


# Boosted trees: fitted on generated examples, used as a column expression.


@dataclass(frozen=True)
class Boost:
    """An ensemble of small trees as nested tuples, and a threshold for each kind."""

    start: float
    trees: tuple
    thresholds: tuple[float, ...]

    def score(self, x) -> Column:
        def node(t) -> Column:
            if isinstance(t, float):
                return F.lit(t)
            feature, cut, low, high = t
            return F.when(x[feature] <= cut, node(low)).otherwise(node(high))

        total = sum((node(t) for t in self.trees), F.lit(self.start))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def selects(self, c: Column) -> Column:
        limits = F.create_map(*(F.lit(v) for pair in zip(KINDS, self.thresholds, strict=True) for v in pair))
        return c["base"] | (self.score(c["x"]) >= F.element_at(limits, c["kind"]))


def examples(n: int = 60, seed: int = 7) -> list[tuple[str, str, int]]:
    """(kind, text, whether its candidate of that kind is personal data); ``n`` of each sort."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 9)))
    long_word = lambda: "".join(r.choice("aeioulnrstdmgcph") for _ in range(r.randint(24, 48)))
    mixed = lambda: "".join(r.choice("abcdef0123456789" if r.random() < 0.5 else "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789") for _ in range(r.randint(24, 64)))
    valid_ip = lambda: ".".join(str(r.randint(1, 255)) for _ in range(4))
    wrong_ip = lambda: f"{r.randint(256, 999)}.{d(1)}.{r.randint(256, 999)}.{d(2)}"

    def card(good: bool) -> str:
        body = "4" + d(14)
        total = sum(x - 9 if x > 9 else x for x in (int(c) * (2 if k % 2 == 0 else 1) for k, c in enumerate(body)))
        return body + str((10 - total % 10 + (0 if good else r.randint(1, 9))) % 10)

    def iban(good: bool) -> str:
        body = d(18)
        check = 98 - int(body + "131400") % 97
        return f"DE{check if good else (check + r.randint(1, 90)) % 97:02d}{body}"

    sorts = {
        "email": (lambda: f"{word()}{d(2)}@{word()}.com", lambda: f"{word()} [at] {word()} [dot] com", None),
        "ip": (valid_ip, None, wrong_ip),
        "card": (lambda: card(True), None, lambda: card(False)),
        "phone": (lambda: f"+1 ({d(3)}) 555-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}"),
        "ssn": (lambda: f"{r.randint(100, 650)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", None, lambda: f"000-{d(2)}-{d(4)}"),
        "iban": (lambda: iban(True), None, lambda: iban(False)),
        "secret": (mixed, None, long_word),
    }
    hints = {"email": "mail", "ip": "host", "card": "card", "phone": "phone", "ssn": "ssn", "iban": "iban", "secret": 'key = "'}
    out = []
    for kind, (plain, other, wrong) in sorts.items():
        for _ in range(n):
            lead = lambda: f"{word()} {word()} "
            for make, label in ((plain, 1), (other, 1), (wrong, 0)):
                if make:
                    hint = hints[kind] + ("" if hints[kind].endswith('"') else ": ") if r.random() < (0.7 if label else 0.2) else ""
                    out.append((kind, f"{lead()}{hint}{make()} {lead()}", label))
            # the same strings glued into something longer are not personal data
            out.append((kind, f"{lead()}{word()}{plain()}{word()} {lead()}", int(kind in ("email", "ip", "card"))))
    symbols = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_"
    for k in range(n):  # the longest keys and the shortest account numbers; last, so that the examples above stay the same
        body = d(11)
        out.append(("secret", f"{word()} {hints['secret'] if k % 3 else ''}{''.join(r.choice(symbols[: -2 if k % 4 < 2 else None]) for _ in range(r.randint(100, 1200)))} {word()}", 1))
        out.append(("iban", f"{word()} {'iban: ' if k % 3 else ''}NO{98 - int(body + '232400') % 97:02d}{body} {word()}", 1))
        out.append(("secret", f"{word()} {''.join(r.choice('aeioulnrstdmgcph') for _ in range(r.randint(100, 1200)))} {word()}", 0))
        out.append(("iban", f"{word()} NO{(98 - int(body + '232400') % 97 + r.randint(1, 90)) % 97:02d}{body} {word()}", 0))
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, rate: float):
    """A regression tree on gradients and curvatures, splitting where the gain is largest."""
    value = float(rate * g[rows].sum() / (h[rows].sum() + 1))
    best = (1e-6, None)
    if depth:
        for f in range(x.shape[1]):
            cuts = np.unique(x[rows, f])
            for cut in (cuts[:-1] + cuts[1:])[:: max(1, len(cuts) // 16)] / 2:
                low = rows[x[rows, f] <= cut]
                high = rows[x[rows, f] > cut]
                if min(len(low), len(high)) >= 5:
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (low, high)) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                    if gain > best[0]:
                        best = (gain, (f, cut, low, high))
    if best[1] is None:
        return value
    f, cut, low, high = best[1]
    return (FEATURES[f], float(cut), _grow(x, g, h, low, depth - 1, rate), _grow(x, g, h, high, depth - 1, rate))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, FEATURES.index(f)] <= cut, _apply(low, x), _apply(high, x))


_fitted: dict[tuple, Boost] = {}


def fit(spark: SparkSession, trees: int = 24, depth: int = 3, rate: float = 0.4, n: int = 60, seed: int = 7, precision: float = 0.99) -> Boost:
    """Boosted trees over the features of generated examples; thresholds from the half held out.

    The number of examples is fixed by ``n``, whatever the corpus.
    """
    key = (trees, depth, rate, n, seed, precision)
    if key in _fitted:
        return _fitted[key]
    made = examples(n, seed)
    frame = spark.createDataFrame([(k, kind, text, label) for k, (kind, text, label) in enumerate(made)], "id long, kind string, text string, label int")
    rows = frame.withColumn("c", F.explode(candidates(F.col("text")))).filter("c.kind = kind").select("id", "kind", "label", "c.x.*").orderBy("id", *FEATURES[1:])
    got = rows.toDF("id", "of", "label", *FEATURES).collect()
    x = np.array([[r[f] for f in FEATURES] for r in got])
    y = np.array([r["label"] for r in got], float)
    kind, held = np.array([KINDS.index(r["of"]) for r in got]), np.array([r["id"] for r in got]) % 2 == 1
    start = float(np.log(y.mean() / (1 - y.mean())))
    total, grown = np.full(len(y), start), []
    rows_at = np.flatnonzero(~held)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        tree = _grow(x, y - p, p * (1 - p), rows_at, depth, rate)
        grown.append(tree)
        total = total + _apply(tree, x)
    p = 1 / (1 + np.exp(-total))
    limits = []
    for k in range(len(KINDS)):
        own = held & (kind == k)
        fits = [c for c in np.unique(p[own]) if c >= 0.5 and y[own & (p >= c)].mean() >= precision]
        limits.append(float(min(fits)) - 1e-9 if fits else 1.1)
    _fitted[key] = Boost(start, tuple(grown), tuple(limits))
    return _fitted[key]


def spans(docs: DataFrame, text: str = "text", out: str = "spans", model: Boost | None = None) -> DataFrame:
    """``docs`` with array<struct<kind, start, end, base>>, by kind as listed, then start, then end.

    Of further spans of a kind only those count that no base span of the kind overlaps.
    """
    model = model or fit(docs.sparkSession)
    clean, found = fresh(docs, "_clean"), fresh(docs, "_found")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    plain = docs.withColumn(clean, F.when(F.contains(body, F.lit(MARK)), F.replace(body, F.lit(MARK), F.lit(OTHER))).otherwise(body))
    proposed = plain.withColumn(found, candidates(F.col(clean)))
    slim = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"))

    def choose(chosen: Column) -> Column:
        place = F.create_map(*(F.lit(x) for pair in ((kind, k) for k, kind in enumerate(KINDS)) for x in pair))
        at = lambda c, what: F.element_at(place, c["kind"]) * F.lit(FAR) + c[what]

        def add(ordered: Column) -> Column:
            # by kind, then start: a base span that overlaps stands before and ends later, or after and starts earlier
            ends = F.transform(ordered, lambda c: F.when(c["base"], at(c, "end")).otherwise(0))
            starts = F.reverse(F.transform(ordered, lambda c: F.when(c["base"], F.lit(FAR * len(KINDS)) - at(c, "start")).otherwise(0)))

            def free(before: Column) -> Column:
                def alone(after: Column) -> Column:
                    later = lambda k: F.lit(FAR * len(KINDS)) - F.get(after, F.size(ordered) - 1 - k)
                    return F.filter(ordered, lambda c, k: c["base"] | ((F.get(before, k) <= at(c, "start")) & (later(k) >= at(c, "end"))))

                return let(let(starts, _largest), alone)

            return F.transform(let(let(ends, _largest), free), slim)

        by_kind = F.sort_array(F.transform(chosen, lambda c: F.struct(F.element_at(place, c["kind"]).alias("place"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), c["kind"].alias("kind"))))
        return F.when(F.exists(chosen, lambda c: ~c["base"]), let(by_kind, add)).otherwise(F.transform(chosen, slim))

    picked = let(F.filter(F.col(found), model.selects), choose)
    kept = [F.col(f"`{c}`") for c in docs.columns if c != out]
    return proposed.select(*kept, F.when(F.size(found) > 0, picked).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")).alias(out))


def redact(docs: DataFrame, text: str = "text", model: Boost | None = None) -> DataFrame:
    """``docs`` with every span of the text (overlapping ones merged) replaced by its kind in brackets.

    A null text stays null; the other columns stay as they were.
    """
    at = fresh(docs, "_spans")
    found = spans(docs, text, at, model)
    body = F.col(text)

    def cut(ordered: Column, ends: Column, pieces: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            """The body from one place to another, from pieces of PIECE characters: no search from its beginning."""
            a, b = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
            within = F.substring(F.get(pieces, a), (start - a * PIECE + 1).cast("int"), (end - start).cast("int"))
            across = F.concat(F.substr(F.get(pieces, a), (start - a * PIECE + 1).cast("int")), F.array_join(F.slice(pieces, a + 2, b - a - 1), ""), F.left(F.get(pieces, b), (end - b * PIECE).cast("int")))
            return F.when(start >= end, "").when(a == b, within).otherwise(across)

        put = lambda s, k: F.when(s["start"] >= F.get(ends, k), F.concat(piece(F.get(ends, k), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.concat(F.array_join(F.transform(ordered, put), ""), piece(F.element_at(ends, -1), F.length(body).cast(LONG)))

    by_start = F.sort_array(F.transform(F.col(at), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("far"), s["end"].alias("end"), s["kind"].alias("kind"))))
    pieces = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    # where each span meets the furthest end before it; overlapping spans are one
    whole = let(by_start, lambda o: let(_largest(F.transform(o, lambda s: s["end"])), lambda e: let(pieces, lambda p: cut(o, e, p))))
    new = F.when(F.size(at) > 0, whole).otherwise(body)
    return found.select(*(new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))


def _listed(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest are of the base spans."""
    found = spans(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(F.filter("spans", lambda s: s["base"]), _of_kind(kind))).cast(LONG).alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
