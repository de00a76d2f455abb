"""Quality rules: a decision list learned by sequential covering, DataFrame only.

Statistics of each text are column expressions.  From the statistics of labelled
texts (a bounded sample of rows of numbers, held by the driver) rules are grown:
a conjunction of thresholds that picks low-quality texts, condition by condition
by information gain, then pruned on rows set aside, until no further rule is
sound.  The ordered rules become one Spark conditional expression.

Defined cases: null texts have no word; texts without words fail the base rule;
documents that repeat keep their rows; without labels of both kinds no rule is
learned and the base rules alone decide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundflow.llm import common

SAMPLE = 4000      # labelled rows learned from, at most, those of the smallest hash
CUTS = 24          # thresholds tried for each statistic
CONDITIONS = 3     # in one rule
RULES = 12
PRECISION = 0.8    # share of low-quality texts that a rule must keep on rows set aside
LEAST_ROWS = 5     # rows a rule must pick
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]+"
STATISTICS = ("mean_word", "symbols_per_word", "repeat_share", "dup_line_share",
              "bang_share", "distinct_share", "n_words")


def statistics(docs: DataFrame, *more: str) -> DataFrame:
    """Word, line and repetition counts of every text.

    A window of three words is a 64-bit hash whose low bits are replaced by its
    place (as many as the place needs), so one sort of numbers brings equal
    windows together inside the row; nothing is shuffled.
    """
    words = common.texts(docs, *more).withColumn(
        "_w", F.filter(F.split("text", BLANK, -1), lambda w: w != ""))
    sized = words.select("doc_id", "text", *more, "_w", F.size("_w").alias("_n"),
                         F.length(F.bin(F.size("_w").cast("long"))).alias("_b"))
    keys = sized.withColumn("_k", F.expr(
        "sort_array(transform(slice(_w, 1, greatest(_n - 2, 0)), (w, i) -> "
        "shiftleft(shiftrightunsigned(xxhash64(w, get(_w, i + 1), get(_w, i + 2)), _b), _b)"
        " | cast(i as bigint)))"))
    places = keys.withColumn("_p", F.expr(
        "sort_array(transform(filter(_k, (k, i) -> "
        "shiftrightunsigned(k, _b) = coalesce(shiftrightunsigned(get(_k, i + 1), _b), -1L)"
        " or (i > 0 and shiftrightunsigned(k, _b) = shiftrightunsigned(get(_k, i - 1), _b))),"
        " k -> k & (shiftleft(1L, _b) - 1)))"))
    lines = places.withColumn("_l", F.filter(
        F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    counts = lines.select(
        "doc_id", *more, F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(_p, struct(0L as n, -3L as last), (a, p) -> "
               "struct(a.n + least(3L, p - a.last) as n, p as last), a -> a.n)").alias("n_repeat_words"),
        F.size("_l").alias("_lines"), F.size(F.array_distinct("_w")).alias("_distinct"),
        (F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit("")))).alias("_bang"))
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counts.select(
        "doc_id", *more, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / n).alias("mean_word"),
        (F.col("n_symbols") / n).alias("symbols_per_word"),
        (F.col("n_repeat_words") / n).alias("repeat_share"),
        (F.col("n_dup_lines") / F.greatest("_lines", F.lit(1))).alias("dup_line_share"),
        (F.col("_bang") / n).alias("bang_share"), (F.col("_distinct") / n).alias("distinct_share"))


Condition = tuple[str, str, float]  # statistic, ">" or "<=", threshold


def holds(row: dict, rule: list[Condition]) -> bool:
    return all((row[s] > cut) == (side == ">") for s, side, cut in rule)


def _grow(rows: list[dict], cuts: dict[str, list[float]]) -> list[Condition]:
    """Add the condition with the highest gain until only bad rows are left."""
    rule: list[Condition] = []
    while rows and len(rule) < CONDITIONS:
        bad = sum(r["bad"] for r in rows)
        if bad in (0, len(rows)):
            break
        base, best = math.log2(bad / len(rows)), (0.0, None)
        for s, values in cuts.items():
            for cut in values:
                above = [r["bad"] for r in rows if r[s] > cut]
                for side, b, n in ((">", sum(above), len(above)),
                                   ("<=", bad - sum(above), len(rows) - len(above))):
                    if b and n < len(rows) and (gain := b * (math.log2(b / n) - base)) > best[0]:
                        best = gain, (s, side, cut)
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if holds(r, rule[-1:])]
    return rule


def _worth(rows: list[dict], rule: list[Condition]) -> tuple[float, int]:
    picked = [r["bad"] for r in rows if holds(r, rule)]
    return (sum(picked) / len(picked) if picked else 0.0), len(picked)


def learn(docs: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Ordered rules that pick low-quality texts."""
    sample = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL") \
        .select("doc_id", F.col("quality").cast("int").alias("quality")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    labelled = statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "quality")
    rows = [r.asDict() | {"bad": 1 - r["quality"]} for r in labelled.orderBy(F.xxhash64("doc_id")).collect()]
    grow, prune = rows[::3] + rows[1::3], rows[2::3]
    cuts = {s: sorted({v[i * (len(v) - 1) // CUTS] for i in range(CUTS)})
            for s in STATISTICS if (v := sorted(r[s] for r in grow))}
    rules: list[list[Condition]] = []
    while len(rules) < RULES and any(r["bad"] for r in grow):
        rule = _grow(grow, cuts)
        while len(rule) > 1 and _worth(prune, rule[:-1])[0] >= _worth(prune, rule)[0]:
            rule = rule[:-1]
        worth, picked = _worth(prune, rule) if rule else (0.0, 0)
        if worth < PRECISION or picked < LEAST_ROWS:
            break
        rules.append(rule)
        grow = [r for r in grow if not holds(r, rule)]
        prune = [r for r in prune if not holds(r, rule)]
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """0 if no rule picks the text, else the number of the first that does."""
    out = F.lit(0)
    for number, rule in reversed(list(enumerate(rules, 1))):
        picked = F.lit(True)
        for s, side, cut in rule:
            picked &= F.col(s) > cut if side == ">" else F.col(s) <= cut
        out = F.when(picked, number).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return statistics(docs).withColumn("base_failed", failed).withColumn("rule", verdict(rules)) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
