"""Quality rules (operator 9), by DataFrame functions only.

Method: a learned decision list.  Sequential covering over labelled statistics grows a
conjunction of thresholds that covers rejected documents, prunes it on rows kept aside,
removes what it covers and goes on; the list comes out as one ordered Spark conditional
expression over the statistics' columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memstore.llm.common import kept_columns, quoted
from memstore.llm.quality import labelled_sample

#: White space of the word contract, as a Java character class.
_SPACE = "[\\x20\\x09-\\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Bound of the learning sample, in labelled rows.
SAMPLE_ROWS = 8_000
#: Threshold conjunctions: most conditions in one, least rows covered, least precision, most rules.
MAX_CONDITIONS, MIN_COVER, MIN_PRECISION, MAX_RULES = 3, 8, 0.9, 12
STATS = ("words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "distinct_share")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULTS = (*COUNTS, "base_failed", *STATS, "rule", "kept")

Rule = list[tuple[str, str, float]]


def _repeated(step: DataFrame) -> DataFrame:
    """n_repeat_words from __h, the hashes of a text's windows in order.

    Only where two hashes are equal are (hash, place) pairs sorted; the places of equal
    neighbours, in order, each cover the words up to the next place, WINDOW at most.
    """
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    pairs = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("__p", F.when(F.size("__h") > F.size(F.array_distinct("__h")), pairs).otherwise(nothing))
    at = lambda k: F.get("__p", k)
    equal = F.filter(F.sequence(F.lit(1), F.size("__p") - 1), lambda k: at(k - 1)["h"] == at(k)["h"])
    places = F.sort_array(F.array_distinct(F.flatten(F.transform(equal, lambda k: F.array(at(k - 1)["i"], at(k)["i"])))))
    step = step.withColumn("__e", F.when(F.size("__p") > 1, places).otherwise(F.array().cast("array<int>")))
    last = F.lit(WINDOW)
    covered = F.transform("__e", lambda x, k: F.least(F.coalesce(F.get("__e", k + 1) - x, last), last))
    return step.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)).drop("__p", "__e")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of docs and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed and STATS.  A null text counts as an empty one: all counts are 0.  A column of
    docs that is named like a result is left out.  Rows are independent, so repeated rows and
    null ids come back as they are.  One projection over another, no shuffle: each row holds
    its own words, and no more.
    """
    own = kept_columns(docs.columns, RESULTS)
    docs = docs.select(F.struct(F.lit(0).alias("__"), *quoted(own)).alias("__in"), F.col(f"`{text_col}`").alias("__text"))
    text = F.coalesce(F.col("__text"), F.lit(""))
    solid = F.translate("__t", _BLANKS, "")
    inner = F.btrim(F.col("__t"), F.lit(_BLANKS))
    step = docs.withColumn("__t", text).withColumn("__w", F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _SPACE)))
    step = step.withColumn("n_words", F.size("__w").cast("long")).withColumn("word_chars", F.length(solid).cast("long"))
    step = step.withColumn("n_symbols", (F.length("__t") - F.length(F.translate("__t", _SYMBOLS, ""))).cast("long"))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0)
    step = step.withColumn("__l", lines).withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    windows = F.transform(F.sequence(F.lit(1), F.size("__w") - WINDOW + 1), lambda i: F.xxhash64(F.slice("__w", i, WINDOW)))
    step = step.withColumn("__h", F.when(F.size("__w") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    step = _repeated(step)
    step = step.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    some, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    stats = {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / some,
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.size("__l"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / some,
        "upper_share": (F.length("__t") - F.length(F.translate("__t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) / chars,
        "mark_share": (F.length("__t") - F.length(F.translate("__t", "!?\"'()[]{}=_~^;:", ""))) / chars,
        "distinct_share": F.size(F.array_distinct("__w")) / some,
    }
    for name, c in stats.items():
        step = step.withColumn(name, F.round(c.cast("double"), 6))
    return step.select(*[F.col(f"__in.`{c}`").alias(c) for c in own], *COUNTS, "base_failed", *STATS)


def learn(rows: list[tuple[tuple[float, ...], int]]) -> list[Rule]:
    """An ordered list of conjunctions that reject; rows: (STATS, 1 to keep or 0 to reject).

    Two rows of three grow a rule, the third prunes it: conditions go from the end while
    that doesn't lower precision there.
    """
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    holds = lambda rule, x: all(x[STATS.index(c)] >= v if op == ">=" else x[STATS.index(c)] <= v for c, op, v in rule)

    def precision(rule: Rule, part: list) -> tuple[float, int]:
        got = [y for x, y in part if holds(rule, x)]
        return (len(got) - sum(got) + 1) / (len(got) + 2), len(got)

    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        bad = sum(1 for _, y in grow if not y)
        if bad < MIN_COVER:
            break
        rule: Rule = []
        part = grow
        for _ in range(MAX_CONDITIONS):
            n, neg = len(part), sum(1 for _, y in part if not y)
            if neg == n:
                break
            base, best = math.log2((neg + 1) / (n + 2)), (0.0, None)
            for k, name in enumerate(STATS):
                seen = sorted((x[k], y) for x, y in part)
                for ordered, op in ((seen, "<="), (seen[::-1], ">=")):
                    total = wrong = 0
                    for i, (v, y) in enumerate(ordered):
                        total += 1
                        wrong += not y
                        if total < MIN_COVER or total == n or (i + 1 < n and ordered[i + 1][0] == v):
                            continue
                        gain = wrong * (math.log2((wrong + 1) / (total + 2)) - base)
                        if gain > best[0]:
                            best = (gain, (name, op, (v + ordered[i + 1][0]) / 2))
            if best[1] is None:
                break
            rule = [*rule, best[1]]
            part = [r for r in part if holds([best[1]], r[0])]
        while len(rule) > 1 and precision(rule[:-1], prune)[0] >= precision(rule, prune)[0]:
            rule = rule[:-1]
        p, n = precision(rule, prune) if rule else (0.0, 0)
        p = (p * (n + 2) - 1) / max(n, 1)
        left = [r for r in grow if not holds(rule, r[0])]
        if not rule or p < MIN_PRECISION or n < 3 or len(left) == len(grow):
            break
        rules.append(rule)
        grow, prune = left, [r for r in prune if not holds(rule, r[0])]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional expression: the number of the first rule that rejects, 0 for none."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        test = F.lit(True)
        for name, op, v in rule:
            test = test & (F.col(name) >= v if op == ">=" else F.col(name) <= v)
        out = F.when(test, F.lit(i)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """Rules from at most SAMPLE_ROWS labelled documents, those of least id hash; their statistics come to the driver.
    What the base rule rejects isn't learned from.
    Without labels of both kinds there are no rules."""
    sample = labelled_sample(docs, labels, label_col, id_col, text_col, SAMPLE_ROWS).select(F.col(f"`{id_col}`").alias("__id"), "__y", F.col(f"`{text_col}`").alias("__text"))
    rows = statistics(sample, "__text").select("__id", F.col("__y").cast("int"), "base_failed", *STATS).collect()
    rows.sort(key=lambda r: (hash((r[0] * 2654435761) % 2**32) if isinstance(r[0], int) else 0, str(r[0]), tuple(r)[1:]))
    return learn([(tuple(r)[3:], r[1]) for r in rows if not r["base_failed"]])


def apply_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The statistics of every row, rule (the first that rejects, or 0) and kept."""
    out = statistics(docs, text_col).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
