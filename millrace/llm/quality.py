"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

``measures`` counts words, symbols, repeated lines and repeated passages of whole
texts. A few rules compare these counts with a cutoff. Cutoffs are not set by hand:
for each rule and stratum (language) the documents labelled good are the holdout,
and a cutoff is allowed if the chance that it rejects a good document is at most
``alpha`` by the exact binomial (Clopper-Pearson) bound. All candidates of all rules
and strata are tested at once, so each is tested at ``delta`` divided by their number
(Bonferroni); with probability ``1 - delta`` every selected cutoff keeps its promise.
``alpha`` is shared out evenly among the rules, so the promise holds for all rules
together. Of the allowed cutoffs the strictest is taken; where none is allowed (too
few labels) the rule rejects nothing in that stratum.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, settle

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Rejects where ``scale * left > cutoff * right``; cutoffs run from mild to strict."""
    name: str
    left: str
    right: str
    scale: int
    cutoffs: tuple[int, ...]


RULES = (
    Rule("symbols", "n_symbols", "word_chars", 1000, (600, 400, 300, 200, 100, 50)),
    Rule("dup_lines", "n_dup_lines", "n_words", 1000, (200, 100, 50, 20)),
    Rule("repeats", "n_repeat_words", "n_words", 100, (18, 15, 10, 5)),
    Rule("long_words", "word_chars", "n_words", 1, (30, 20, 15, 12)),
)

ALPHA, DELTA = 0.02, 0.05


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in windows of five that occur twice or more in the text."""
    def places(hashes: Column) -> Column:
        """Starts of the windows whose hash is not unique, in order."""
        def marked(s: Column) -> Column:
            same = lambda x, i, k: s[i + k]["h"] == x["h"]
            return F.filter(
                F.transform(s, lambda x, i: F.when((i > 0) & same(x, i, -1), x["i"])
                            .when((i < F.size(s) - 1) & same(x, i, 1), x["i"])), lambda x: x.isNotNull())
        by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.array_sort(let(by_hash, marked))

    def covered(at: Column) -> Column:
        """Words that windows starting there cover: five, or up to the next start."""
        return F.aggregate(
            F.transform(at, lambda x, i: F.when(i < F.size(at) - 1, F.least(F.lit(WINDOW), at[i + 1] - x))
                        .otherwise(F.lit(WINDOW))), F.lit(0).cast("long"), lambda total, x: total + x)

    def repeats(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(places(hashes), covered))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW),
                           lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)]))

    word_hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(n >= WINDOW, let(let(word_hashes, windows), repeats)).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    base_failed; columns of these names are replaced.

    Words are runs without ASCII white space. A null text counts as empty: no words,
    so base_failed. base_failed: fewer than 10 words, or more than 20 % of the words
    in repeated five-word windows. Repeated windows are found by 64-bit hashes.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def counts(w: Column) -> Column:
        n = F.size(w).cast("long")
        return F.struct(n.alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                        _repeat_words(w, n).alias("n_repeat_words"))

    measured = docs.withColumn("_m", F.explode(F.array(F.struct(
        let(words, counts).alias("w"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines")))))
    out = measured.withColumns({
        "n_words": F.col("_m.w.n_words"), "word_chars": F.col("_m.w.word_chars"), "n_symbols": F.col("_m.n_symbols"),
        "n_dup_lines": F.col("_m.n_dup_lines"), "n_repeat_words": F.col("_m.w.n_repeat_words")}).drop("_m")
    return out.withColumn("base_failed", (F.col("n_words") < 10)
                          | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _rejects(rule: Rule, cutoff: Column) -> Column:
    return rule.scale * F.col(rule.left) > cutoff * F.col(rule.right)


def log_tail(n: int, k: int, p: float) -> float:
    """Logarithm of the chance of at most ``k`` successes in ``n`` trials, exact to a
    float's precision. From ``k`` downwards terms shrink ever faster below the mean, so the
    number summed grows with the square root of ``n`` at most."""
    top = (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
           + k * math.log(p) + (n - k) * math.log1p(-p))
    term = total = 1.0
    for i in range(k, 0, -1):
        growth = i * (1 - p) / ((n - i + 1) * p)
        term *= growth
        total += term
        if growth < 1 and term < 1e-18 * total:
            break
    return top + math.log(total)


def allowed(n: int, k: int, alpha: float, level: float) -> bool:
    """Whether ``k`` rejected of ``n`` good documents show, at this error level, a
    rejection rate of at most ``alpha``: the upper Clopper-Pearson bound is at most
    ``alpha`` exactly when so few rejections have at most this chance at that rate."""
    return n > 0 and k < alpha * n and log_tail(n, k, alpha) <= math.log(level)


def cutoffs(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", stratum: str = "lang",
            quality: str = "quality", rules: tuple[Rule, ...] = RULES, alpha: float = ALPHA,
            delta: float = DELTA) -> dict[tuple[str | None, str], int]:
    """The strictest allowed cutoff by stratum and rule. The holdout is every document
    that a label calls good (1) and that passes the base rules; a document labelled
    twice with different qualities counts as not good, null labels do not count.

    Only counts, one row per stratum, reach the driver."""
    good = (labels.groupBy(F.col(doc_id).alias("_doc")).agg(F.min(quality).alias("_good"))
            .where("_good = 1").select("_doc"))
    needed = dict.fromkeys(["base_failed", *[c for r in rules for c in (r.left, r.right)]])
    held = (measured.select(F.col(doc_id).alias("_doc"), F.col(stratum).alias("_stratum"), *needed)
            .where("not base_failed").join(good, "_doc", "left_semi"))
    tried = [(rule, c) for rule in rules for c in rule.cutoffs]
    counts = held.groupBy(F.col("_stratum").alias("stratum")).agg(
        F.count("*").alias("n"),
        *[F.count_if(_rejects(rule, F.lit(c))).alias(f"{rule.name}_{c}") for rule, c in tried]).collect()
    level = delta / max(1, len(tried) * len(counts))
    chosen = {}
    for row in counts:
        for rule, c in tried:   # from mild to strict: the last allowed one stays
            if allowed(row["n"], row[f"{rule.name}_{c}"], alpha / len(rules), level):
                chosen[row["stratum"], rule.name] = c
    return chosen


def judge(measured: DataFrame, chosen: dict[tuple[str | None, str], int], stratum: str = "lang",
          rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measured`` with kept: neither base_failed nor rejected by a rule of its stratum."""
    verdicts = [F.col("base_failed")]
    for rule in rules:
        for (name, of), c in chosen.items():
            if of == rule.name:
                verdicts.append(F.col(stratum).eqNullSafe(F.lit(name)) & _rejects(rule, F.lit(c)))
    return measured.withColumn("kept", ~reduce(lambda a, b: a | b, verdicts))


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
            stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``docs`` with the measures, base_failed and kept, one row per input row.

    Empty tables, null ids and null strata are allowed: a null stratum is one of its
    own, and without labels only the base rules reject.
    """
    measured = settle(measures(docs, text), "measured")   # read for the cutoffs and for the verdicts
    return judge(measured, cutoffs(measured, labels, doc_id, stratum, alpha=alpha, delta=delta), stratum)
