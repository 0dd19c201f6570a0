"""Quality rules as a bitmask ledger, in DataFrame expressions only.

Every rule is evaluated once for a document. The ledger keeps the
measurements and one bit for each failed rule; a policy is a versioned mask of
the rules that reject, so a new policy, or the ablation of any rule, is
bitwise arithmetic over the ledger and never reads a text again.

Edge cases: a null text counts as empty (no words, so too short); an empty
table gives an empty ledger; repeated rows are judged one by one; other columns
pass through untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import fresh, let

SPACE = r"[ \x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurements; its place in RULES is its bit."""

    name: str
    fails: object


def _share(part: str, whole: str, percent: int):
    return lambda m: F.lit(100) * m[part] > F.lit(percent) * m[whole]


#: The place of a rule is its bit; rules are only ever appended.
RULES = (
    Rule("too_short", lambda m: m["n_words"] < 50),
    Rule("repeated_words", _share("n_repeat_words", "n_words", 50)),
    Rule("symbols", _share("n_symbols", "n_words", 10)),
    Rule("duplicate_lines", _share("n_dup_lines", "n_lines", 40)),
    Rule("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
    Rule("capitals", _share("n_capitals", "word_chars", 40)),
)
BIT = {rule.name: 1 << k for k, rule in enumerate(RULES)}
BASE = BIT["too_short"] | BIT["repeated_words"]


@dataclass(frozen=True)
class Policy:
    """The rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[name] for name in set(self.rules))


POLICIES = {
    "base-1": Policy("base-1", ("too_short", "repeated_words")),
    "full-1": Policy("full-1", tuple(rule.name for rule in RULES)),
}
DEFAULT = POLICIES["full-1"]


def _repeat_words(words: Column) -> Column:
    """Words within 3-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hash. Most texts end at the distinct count;
    the others sort (hash, start) pairs and look at their neighbours.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))

        def starts(s: Column) -> Column:
            twin = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        start = F.struct(F.lit(-3).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
        step = lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(3).cast("long"), i - a["at"])).alias("n"))
        many = F.aggregate(let(pairs, starts), start, step, lambda a: a["n"])
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), many).otherwise(F.lit(0).cast("long"))

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - 2)
        hashed = F.transform(at, lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(hashed, covered))

    return let(words, windows)


def ledger(docs: DataFrame, text: str = "text", out: str = "ledger") -> DataFrame:
    """``docs`` with a struct column ``out``: the measurements and ``fail_bits``."""
    t, w, l, m = (fresh(docs, f"_{x}") for x in ("text", "words", "lines", "measured"))
    body = F.coalesce(F.col(text), F.lit(""))
    with_words = docs.withColumns({t: body, w: F.array_remove(F.split(body, SPACE, -1), "")})
    with_lines = with_words.withColumn(l, F.filter(F.split(F.col(t), "\n", -1), lambda x: x.rlike(r"[^ \x09-\x0D]")))
    measured = with_lines.withColumn(
        m,
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(F.col(w), "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]", ""))).cast("long").alias("n_capitals"),
            F.size(l).cast("long").alias("n_lines"),
            (F.size(l) - F.size(F.array_distinct(F.col(l)))).cast("long").alias("n_dup_lines"),
            _repeat_words(F.col(w)).alias("n_repeat_words"),
        ),
    )
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(rule.fails(F.col(m)), F.lit(BIT[rule.name])).otherwise(F.lit(0)).cast("long"))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return measured.select(*kept, F.struct(F.col(f"{m}.*"), bits.alias("fail_bits")).alias(out))


def passes(bits: Column, policy: Policy) -> Column:
    """Whether no rule of the policy failed."""
    return bits.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def keep(docs: DataFrame, policy: Policy = DEFAULT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the policy, with their columns as they were."""
    out = fresh(docs, "ledger")
    return ledger(docs, text, out).filter(passes(F.col(out)["fail_bits"], policy)).drop(out)


def ablation(ledgers: DataFrame, policy: Policy = DEFAULT, bits: str = "ledger.fail_bits") -> DataFrame:
    """For each rule of the policy: documents that fail it, fail nothing else, and that pass without it.

    One aggregation over the ledger; texts are not read.
    """
    b = F.col(bits)
    names = sorted(set(policy.rules), key=lambda n: BIT[n])
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(passes(b, policy)).alias("kept")]
    for name in names:
        rest = Policy(policy.version, tuple(n for n in names if n != name))
        failed = b.bitwiseAND(F.lit(BIT[name]).cast("long")) != 0
        sums += [F.count_if(failed).alias(f"f_{name}"), F.count_if(failed & passes(b, rest)).alias(f"o_{name}")]
    one = ledgers.agg(*sums)
    rows = F.explode(
        F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_failed_only"), (F.col("kept") + F.col(f"o_{n}")).alias("n_kept_without")) for n in names])
    )
    return one.select(F.lit(policy.version).alias("policy"), F.col("n").alias("n_docs"), F.col("kept").alias("n_kept"), rows.alias("r")).select("policy", "n_docs", "n_kept", "r.*")


def report(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """A row per document: the measurements, the base verdict and the policy's."""
    base = ~passes(F.col("ledger.fail_bits"), POLICIES["base-1"])
    return ledger(docs.select("doc_id", "text")).select(
        "doc_id",
        *(f"ledger.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")),
        base.alias("base_failed"),
        (~base & passes(F.col("ledger.fail_bits"), policy)).alias("kept"),
        F.col("ledger.fail_bits").alias("fail_bits"),
        F.lit(policy.version).alias("policy"),
    )
