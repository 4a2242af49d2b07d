"""Quality rules: text statistics and learned decision lists, in DataFrame functions only.

Statistics are column expressions.  Sequential covering learns rules for the
documents to drop: each rule grows by the threshold that gains most on the
labelled rows that no earlier rule covers, is pruned from its end on the other
part of the labelled rows, and joins the list if it is precise there.  Each step
is one grouped count in Spark; the driver sees a count by statistic, bin and
label.  The list becomes ordered conditional expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm import common
from tessella.llm.common import SPACE, WORD

SYMBOLS = r"[#*$%&|<>]"
#: Words of a window, and the base rule's limits.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Statistics that rules test, by name: expressions over statistics().
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "cast(n_dup_lines as double)",
    "dup_lines_per_100_words": "100 * n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}
#: Thresholds by statistic; rules; conditions of a rule; least share of drops among the rows that a rule covers.
BINS, RULES, CONDITIONS, PRECISION, LEAST_COVERED = 24, 8, 3, 0.9, 8


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of words that are found twice or more.

    Windows stand by their 64-bit hashes.  Only texts in which two are equal sort
    theirs, to find which ones repeat; the words under those are counted from the
    distances between their starts.
    """

    def count(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            # try_element_at counts from 1 and gives null beyond the ends.
            twice = lambda x, k: (x["h"] == F.try_element_at(s, k + 2)["h"]) | ((k > 0) & (x["h"] == F.try_element_at(s, F.greatest(k, F.lit(1)))["h"]))
            marked = F.transform(s, lambda x, k: F.when(F.coalesce(twice(x, k), F.lit(False)), x["i"]))
            return F.array_sort(F.array_compact(marked))

        def covered(at: Column) -> Column:
            zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).cast("int").alias("last"))
            step = lambda a, i: F.struct((a["n"] + F.least(i - a["last"], F.lit(window))).alias("n"), i.alias("last"))
            return F.aggregate(at, zero, step, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ordered, lambda s: let(starts(s), covered)))

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - window + 1), lambda i: F.xxhash64(F.slice(w, i, window)))

    return let(words, lambda w: F.when(F.size(w) <= window, F.lit(0).cast("long")).otherwise(let(hashes(w), count)))


def statistics(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of every row; null text has no words."""
    text = common.text_or_empty(text_col)
    long = lambda c: c.cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    stats = common.spread(df.select(id_col, text_col)).select(
        F.col(id_col),
        long(F.regexp_count(text, F.lit(WORD))).alias("n_words"),
        long(F.length(F.regexp_replace(text, SPACE, ""))).alias("word_chars"),
        long(F.regexp_count(text, F.lit(SYMBOLS))).alias("n_symbols"),
        long(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
        repeated_words(words_of(text)).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return stats.withColumn("base_failed", failed)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold!r}D"


Rule = tuple[Condition, ...]


def rule_sql(rule: Rule) -> str:
    return " and ".join(f"({c.sql()})" for c in rule)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that covers a row, from 1; 0 if none does."""
    out = F
    for i, rule in enumerate(rules, 1):
        out = out.when(F.expr(rule_sql(rule)), F.lit(i))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def grids(labelled: DataFrame, bad: str = "bad") -> dict[str, list[float]]:
    """Thresholds by statistic: 0, and quantiles of what is above it, as most statistics are 0 for most texts.  None without rows of both kinds."""
    above = lambda n: F.when(F.expr(FEATURES[n]) > 0, F.expr(FEATURES[n]))
    quantiles = (F.percentile_approx(above(n), [i / BINS for i in range(1, BINS)], 2000).alias(n) for n in FEATURES)
    values = labelled.agg(F.count_if(F.col(bad) == 1).alias("n_bad"), F.count_if(F.col(bad) == 0).alias("n_good"), *quantiles).first()
    if not values.n_bad or not values.n_good:
        return {}
    return {n: sorted({0.0, *(values[n] or [])}) for n in FEATURES}


def gain(tally: dict[str, list[list[int]]], grid: dict[str, list[float]]) -> Condition | None:
    """The condition of the largest information gain for bad rows; of equals the first by statistic, threshold and side."""
    best, found = 0.0, None
    for n, bins in tally.items():
        g, b = sum(x[0] for x in bins), sum(x[1] for x in bins)
        if not b or not g:
            return None
        g_low = b_low = 0
        for i, t in enumerate(grid[n]):
            g_low, b_low = g_low + bins[i][0], b_low + bins[i][1]
            for above, (x, y) in ((False, (g_low, b_low)), (True, (g - g_low, b - b_low))):
                if y:
                    worth = y * (math.log2(y / (x + y)) - math.log2(b / (g + b)))
                    if worth > best + 1e-9:
                        best, found = worth, Condition(n, above, float(t))
    return found


def learn(labelled: DataFrame, *, bad: str = "bad", fold: str = "fold") -> list[Rule]:
    """An ordered decision list for rows with bad = 1, from columns of statistics().

    fold = 0 rows prune and test, the others grow.  No rows, or none of either
    kind, give an empty list.  Rows are binned once, into a table of their bins;
    then a condition takes one grouped count, and pruning a rule one aggregate
    over all its prefixes.
    """
    grid = grids(labelled, bad)
    if not grid:
        return []
    names = list(FEATURES)
    # A value's bin is the number of thresholds below it.
    bins = (sum(((F.expr(FEATURES[n]) > t).cast("int") for t in grid[n]), F.lit(0)).alias(f"bin_{i}") for i, n in enumerate(names))
    left = common.written(labelled.select(F.col(bad).alias("bad"), (F.col(fold) == 0).alias("held"), *bins), "bins")

    def holds(rule: Rule) -> Column:
        out = F.lit(True)
        for c in rule:
            above = F.col(f"bin_{names.index(c.feature)}") > grid[c.feature].index(c.threshold)
            out = out & (above if c.above else ~above)
        return out

    def tally(df: DataFrame) -> dict[str, list[list[int]]]:
        """By feature and bin: [good, bad] rows."""
        out = {n: [[0, 0] for _ in range(len(grid[n]) + 1)] for n in names}
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), F.col(f"bin_{i}").alias("bin")) for i in range(len(names)))))
        for r in df.select("bad", each.alias("x")).groupBy("x.feature", "x.bin", "bad").count().collect():
            out[names[r[0]]][r[1]][r[2]] = r[3]
        return out

    rules: list[Rule] = []
    while len(rules) < RULES:
        rule: Rule = ()
        while len(rule) < CONDITIONS:
            condition = gain(tally(left.where(~F.col("held") & holds(rule))), grid)
            if condition is None:
                break
            rule = (*rule, condition)
        if not rule:
            break
        # Pruning: the prefix of the rule that is most precise on unseen rows, the shortest of equals.
        sides = lambda k, held: [F.count_if(holds(rule[:k]) & (F.col("bad") == b) & (F.col("held") | F.lit(not held))) for b in (0, 1)]
        counted = list(left.agg(*(c for k in range(1, len(rule) + 1) for held in (True, False) for c in sides(k, held))).first())
        options = []
        for k in range(1, len(rule) + 1):
            good, poor, all_good, all_poor = counted[4 * k - 4 : 4 * k]
            options.append((round((poor + 1) / (good + poor + 2), 6), -k, all_good, all_poor, good, poor))
        _, k, all_good, all_poor, good, poor = max(options)
        if all_poor < LEAST_COVERED or all_poor < PRECISION * (all_good + all_poor) or poor < PRECISION * (good + poor):
            break
        rules.append(rule[:-k])
        left = left.where(~holds(rule[:-k]))
    return rules


def quality_rules(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[DataFrame, list[Rule]]:
    """(statistics with rule and kept of every row, the learned list).

    rule is the number of the first learned rule that covers a row that the base
    rule passes, else 0; kept is false for rows that either rejects.  Labels: 0
    is to be dropped, 1 kept, null or other values ignored; ids without a row
    are ignored too.  Null text has no words and fails the base rule; repeated
    rows are rows; an empty table gives none; other columns are ignored.
    """
    stats = common.written(statistics(df, id_col=id_col, text_col=text_col), "statistics")
    marks = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), (1 - F.col(label_col)).alias("bad"))
    joined = stats.join(marks, stats[id_col] == F.col("__id")).where("not base_failed")
    labelled = common.written(joined.select(*stats.columns, "bad", F.pmod(F.xxhash64("__id"), F.lit(3)).alias("fold")), "labelled")
    rules = learn(labelled)
    out = stats.withColumn("rule", F.when(F.col("base_failed"), F.lit(0)).otherwise(verdict(rules)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules
