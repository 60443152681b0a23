"""Quality rules: a learned decision list over text statistics, emitted as ordered Spark conditions.

Statistics are DataFrame expressions only (no Python workers). The list is learned by sequential covering from labelled
rows: a rule is a conjunction of thresholds, grown on two thirds of the sample by the information it gains, pruned on
the other third, and kept while its precision there holds; the rows it covers leave, and the next rule follows. Learning
uses plain Python on the driver over at most ``FIT_ROWS`` labelled rows of smallest key hash, a documented bound;
statistics and verdicts cover all rows.

Repeated windows are told by 64 bits of hash (xxhash64). The sample holds one row for each labelled key and label, so
repeated doc_ids don't enlarge it.

Defined results: a null or empty text has no words, so it fails the base rule and is not kept; repeated rows get equal
results; without usable labels the list is empty and only the base rule decides; extra columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import private

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FIT_ROWS = 20_000
#: A rule needs this share of bad rows, and so many of them, on the rows it is pruned on.
PRECISION, SUPPORT = 0.95, 3
MOST_RULES, MOST_CONDITIONS = 12, 4
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_upper", "n_letters", "n_exclaim", "n_digits", "n_chars_all", "n_ends"]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the BASE and MORE counts (long) to every row."""
    p = private(docs)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    removed = lambda chars: (F.length(f"{p}t") - F.length(F.translate(f"{p}t", chars, ""))).cast("long")
    docs = docs.drop(*BASE, *MORE).withColumn(f"{p}t", t).withColumn(f"{p}b", F.btrim(f"{p}t", F.lit(SPACES)))
    docs = docs.withColumn(f"{p}w", F.when(F.col(f"{p}b") == "", F.array().cast("array<string>")).otherwise(F.split(f"{p}b", r"[ \t-\r]+")))
    # lambdas refer to their own arguments only: if Spark moves an expression, it is not evaluated again for each element
    three = F.arrays_zip(*(F.slice(f"{p}w", F.lit(k), F.greatest(F.size(f"{p}w") - 2, F.lit(0))).alias(f"w{k}") for k in (1, 2, 3)))
    docs = docs.withColumn(f"{p}z", three).withColumn(f"{p}h", F.transform(f"{p}z", lambda x: F.xxhash64(x["w1"], x["w2"], x["w3"])))
    docs = docs.withColumn(f"{p}l", F.filter(F.split(f"{p}t", "\n"), lambda x: F.translate(x, SPACES, "") != ""))
    # places of windows that are found twice or more; only texts with such a window sort theirs
    pairs = F.sort_array(F.transform(f"{p}h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    docs = docs.withColumn(f"{p}s", F.when(F.size(F.array_distinct(f"{p}h")) < F.size(f"{p}h"), pairs))
    rest = F.size(f"{p}s") - 1
    beside = F.arrays_zip(F.col(f"{p}s").alias("own"), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(f"{p}s", F.lit(1), rest)).alias("before"), F.slice(f"{p}s", F.lit(2), rest).alias("after"))
    twice = F.filter(beside, lambda x: F.coalesce(x["own"]["h"] == x["before"]["h"], F.lit(False)) | F.coalesce(x["own"]["h"] == x["after"]["h"], F.lit(False)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["own"]["i"], x["own"]["i"] + 1, x["own"]["i"] + 2)))))
    columns = {
        "n_words": F.size(f"{p}w"), "word_chars": F.length(F.translate(f"{p}t", SPACES, "")), "n_symbols": removed(SYMBOLS), "n_dup_lines": F.size(f"{p}l") - F.size(F.array_distinct(f"{p}l")),
        "n_repeat_words": F.when(F.col(f"{p}s").isNull(), 0).otherwise(covered), "n_upper": F.length(f"{p}t") - F.length(F.regexp_replace(f"{p}t", r"\p{Lu}", "")),
        "n_letters": F.length(f"{p}t") - F.length(F.regexp_replace(f"{p}t", r"\p{L}+", "")), "n_exclaim": removed("!?"), "n_digits": removed("0123456789"), "n_chars_all": F.length(f"{p}t"), "n_ends": removed(".,;:"),
    }
    return docs.withColumns({k: v.cast("long") for k, v in columns.items()}).drop(*(f"{p}{x}" for x in "tbwzhls"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What thresholds apply to; shares are per word or per character."""
    per_word = lambda c: F.col(c) / F.greatest("n_words", F.lit(1))
    return {
        "words": F.col("n_words").cast("double"), "word_length": per_word("word_chars"), "symbols": per_word("n_symbols"), "dup_lines": F.col("n_dup_lines").cast("double"),
        "repeats": per_word("n_repeat_words"), "upper": F.col("n_upper") / F.greatest("n_letters", F.lit(1)), "letters": F.col("n_letters") / F.greatest("word_chars", F.lit(1)),
        "exclaim": per_word("n_exclaim"), "digits": F.col("n_digits") / F.greatest("word_chars", F.lit(1)), "ends": per_word("n_ends"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.threshold if self.above else row[self.feature] <= self.threshold

    def column(self) -> Column:
        value = features()[self.feature]
        return value >= self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def _best(bad: list[dict], good: list[dict], name: str) -> tuple[float, Condition | None]:
    """The threshold of a feature that gains most information, by one sweep over the sorted values."""
    ordered = sorted([(r[name], 1) for r in bad] + [(r[name], 0) for r in good])
    n, n_bad = len(ordered), len(bad)
    before = math.log2(n_bad / n)
    best, most, seen_bad = None, 0.0, 0
    for k in range(n - 1):
        seen_bad += ordered[k][1]
        if ordered[k][0] == ordered[k + 1][0]:
            continue
        for p, size, above in ((seen_bad, k + 1, False), (n_bad - seen_bad, n - k - 1, True)):
            if p and (gain := p * (math.log2(p / size) - before)) > most + 1e-12:
                best, most = Condition(name, above, (ordered[k][0] + ordered[k + 1][0]) / 2), gain
    return most, best


def _grow(bad: list[dict], good: list[dict], names: list[str]) -> Rule:
    rule: Rule = ()
    while good and bad and len(rule) < MOST_CONDITIONS:
        _, best = max((_best(bad, good, name) for name in names), key=lambda x: x[0])
        if best is None:
            break
        rule = (*rule, best)
        bad, good = [r for r in bad if best.holds(r)], [r for r in good if best.holds(r)]
    return rule


def learn(rows: list[tuple[dict, bool]]) -> list[Rule]:
    """Rules that find bad rows, in order. ``rows``: (features, is bad), in a fixed random order."""
    if not rows:
        return []
    names = sorted(rows[0][0])
    grow = [r for k, r in enumerate(rows) if k % 3]
    prune = [r for k, r in enumerate(rows) if not k % 3]
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        bad, good = ([r for r, is_bad in grow if is_bad is want] for want in (True, False))
        rule = _grow(bad, good, names)
        if not rule:
            break

        def score(k: int, rule: Rule = rule) -> tuple[float, int]:
            p, n = (sum(_covers(rule[:k], r) for r, is_bad in prune if is_bad is want) for want in (True, False))
            return (p - n) / max(p + n, 1), p

        size = max(range(1, len(rule) + 1), key=lambda k: (*score(k), -k))
        rule = rule[:size]
        p, n = (sum(_covers(rule, r) for r, is_bad in prune + grow if is_bad is want) for want in (True, False))
        own_p, own_n = (sum(_covers(rule, r) for r, is_bad in prune if is_bad is want) for want in (True, False))
        if p < SUPPORT or p < PRECISION * (p + n) or own_p < PRECISION * (own_p + own_n):
            break
        rules.append(rule)
        grow, prune = ([x for x in part if not _covers(rule, x[0])] for part in (grow, prune))
    return rules


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = FIT_ROWS) -> list[Rule]:
    """Learns from labelled rows (0: bad) that pass the base rule. The sample is bounded, so it is broadcast to the texts."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), (F.col(label) == 0).alias("_bad"))
    sample = known.distinct().orderBy(F.xxhash64("_key"), "_key", "_bad").limit(rows)
    found = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(sample), "_key")
    columns = features()
    measured = statistics(found).select("_key", "_bad", F.struct(base_failed().alias("_failed"), *(c.alias(k) for k, c in columns.items())).alias("_row"))
    measured = measured.groupBy("_key", "_bad").agg(F.min("_row").alias("_row")).select(F.xxhash64("_key").alias("_h"), "_key", "_bad", "_row.*").collect()
    measured.sort(key=lambda r: (r["_h"], str(r["_key"]), r["_bad"]))
    return learn([({k: r[k] for k in columns}, r["_bad"]) for r in measured if not r["_failed"]])


def verdict(rules: list[Rule]) -> Column:
    """The list as ordered conditions: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        condition = rule[0].column()
        for c in rule[1:]:
            condition = condition & c.column()
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Adds the statistics, base_failed and kept to every row."""
    return statistics(docs.drop("base_failed", "kept"), text).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
