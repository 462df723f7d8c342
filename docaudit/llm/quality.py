"""Quality rules by weak supervision, in DataFrame functions only.

Rules vote bad, good or abstain. Expectation-maximisation over the counts of vote patterns estimates how each rule
votes on good and on bad documents, and how common these are; the posterior probability of good replaces
all-must-pass filtering, so that a weak rule's bad vote is overruled by others' good ones. At first a document with
any bad vote is held for bad. As rules are written to pass good documents, no rule is believed to vote bad on more
than FALSE_ALARM of them; without that bound the class of bad shrinks to the commonest kind of junk. Sweeps end when no
estimate moves by TOLERANCE. They run over the table of patterns, at most 3 to the number of rules rows, whose size
doesn't depend on the corpus.

Defined results: null text has no words (all counts 0, base_failed); repeated rows are judged each
on its own; a posterior of just keep_at is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import SPACE, persisted, removed

SYMBOLS = "#*$%&|<>"
CAPITALS = "A-ZÀ-ÖØ-Þ"
TOLERANCE, SWEEPS, FALSE_ALARM = 1e-3, 500, 0.02
#: Each row: rule, feature, bad where feature > first bound, good where feature <= second bound (none: never votes good).
RULES = (
    ("symbols", "symbol_share", 0.10, 0.02),
    ("bare_symbols", "bare_share", 0.05, None),
    ("dup_lines", "dup_line_share", 0.40, 0.0),
    ("repeats", "repeat_share", 0.30, 0.02),
    ("capitals", "capital_share", 0.30, 0.08),
    ("shouting", "shout_share", 0.20, None),
    ("long_words", "word_length", 6.5, 5.6),
)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's counts and the shares that the rules judge, one row for each document.

    Windows of three words are compared by a 64-bit hash; only documents in which two are equal sort
    them to find which. Each step stands in a projection of its own, so that none runs twice."""
    none = F.expr("cast(array() as array<struct<h:bigint,i:int>>)")
    nth = lambda k: F.get(F.col("_gs"), k)["h"]
    same = lambda g, k: F.coalesce(nth(k - 1) == g["h"], F.lit(False)) | F.coalesce(nth(k + 1) == g["h"], F.lit(False))
    x = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    x = x.select(
        "doc_id",
        F.array_remove(F.split("_t", SPACE, -1), "").alias("_w"),
        F.filter(F.split("_t", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
        F.regexp_count("_t", F.lit(f"(?<![^\\x20\\x09-\\x0D])[{SYMBOLS}]+(?![^\\x20\\x09-\\x0D])")).alias("_n_bare"),
        F.regexp_replace("_t", f"[^{SYMBOLS}!{CAPITALS}]+", "").alias("_s"),
    )
    x = x.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    x = x.withColumn("_g", F.transform(
        F.slice("_h", F.lit(1), F.greatest(F.size("_h") - 2, F.lit(0))),
        lambda h, i: h.bitwiseXOR(F.shiftleft(F.get("_h", i + 1), 1)).bitwiseXOR(F.shiftleft(F.get("_h", i + 2), 2)),
    ))
    x = x.withColumn("_gs", F.when(F.size(F.array_distinct("_g")) == F.size("_g"), none).otherwise(
        F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ))
    x = x.withColumn("_r", F.when(F.size("_gs") == 0, F.expr("cast(array() as array<int>)")).otherwise(
        F.sort_array(F.transform(F.filter("_gs", same), lambda g: g["i"]))
    ))
    covered = F.aggregate(
        F.col("_r"), F.struct(F.lit(0).alias("c"), F.lit(-3).alias("p")),
        lambda a, i: F.struct((a["c"] + F.least(F.lit(3), i - a["p"])).alias("c"), i.alias("p")), lambda a: a["c"],
    )
    x = x.select(
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_s", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_r") == 0, 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.size("_l").alias("_n_lines"),
        "_n_bare",
        F.length(F.regexp_replace("_s", "[^!]+", "")).alias("_n_shout"),
        F.length(F.regexp_replace("_s", f"[^{CAPITALS}]+", "")).alias("_n_caps"),
    )
    return x.withColumns({
        "symbol_share": F.col("n_symbols") / F.greatest("n_words", F.lit(1)),
        "bare_share": F.col("_n_bare") / F.greatest("n_words", F.lit(1)),
        "dup_line_share": F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
        "capital_share": F.col("_n_caps") / F.greatest("word_chars", F.lit(1)),
        "shout_share": F.col("_n_shout") / F.greatest("n_words", F.lit(1)),
        "word_length": F.col("word_chars") / F.greatest("n_words", F.lit(1)),
    }).drop("_n_lines", "_n_bare", "_n_shout", "_n_caps")


def votes(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds v_<rule>: 0 bad, 1 good, 2 abstains (also for texts without words)."""
    return df.withColumns({
        f"v_{name}": F.when(F.col("n_words") == 0, 2).when(F.col(of) > bad, 0).when(F.col(of) <= (float("-inf") if good is None else good), 1).otherwise(2)
        for name, of, bad, good in rules
    })


def posterior(params: dict, rules=RULES) -> Column:
    """Probability that a row with these votes is good."""
    odds = F.lit(math.log(params["good"] / (1 - params["good"])))
    for name, *_ in rules:
        told = [math.log(params[name, "good", v] / params[name, "bad", v]) for v in range(3)]
        odds = odds + F.element_at(F.array(*[F.lit(x) for x in told]), F.col(f"v_{name}") + 1)
    return 1 / (1 + F.exp(-odds))


def sums(patterns: DataFrame, good: Column, rules=RULES) -> dict:
    """Weights of the classes and of each vote within them, given each pattern's probability of good; one row."""
    q = patterns.withColumn("_q", good)
    of = {"good": F.col("n") * F.col("_q"), "bad": F.col("n") * (1 - F.col("_q"))}
    each = [F.sum(w).alias(c) for c, w in of.items()]
    each += [F.sum(F.when(F.col(f"v_{name}") == v, w).otherwise(0.0)).alias(f"{name}/{c}/{v}") for name, *_ in rules for c, w in of.items() for v in range(3)]
    return {k: x or 0.0 for k, x in q.agg(*each).first().asDict().items()}


def estimated(found: dict, rules=RULES, false_alarm: float = FALSE_ALARM) -> dict:
    """Share of good, and P(vote | class) by (rule, class, vote), each count raised by one."""
    params = {"good": (found["good"] + 1) / (found["good"] + found["bad"] + 2)}
    for name, *_ in rules:
        for c in ("good", "bad"):
            p = [(found[f"{name}/{c}/{v}"] + 1) / (found[c] + 3) for v in range(3)]
            if c == "good" and p[0] > false_alarm:
                p = [false_alarm, *[x / (1 - p[0]) * (1 - false_alarm) for x in p[1:]]]
            params |= {(name, c, v): p[v] for v in range(3)}
    return params


def fit(voted: DataFrame, rules=RULES, tolerance: float = TOLERANCE, sweeps: int = SWEEPS, false_alarm: float = FALSE_ALARM) -> dict:
    """EM over the counts of vote patterns until no estimate moves by tolerance; raises if sweeps don't get there."""
    names = [f"v_{n}" for n, *_ in rules]
    patterns = persisted(voted.groupBy(*names).agg(F.count("*").cast("double").alias("n")).coalesce(1), "patterns")
    fired = reduce(lambda a, b: a | b, [F.col(n) == 0 for n in names])
    params = estimated(sums(patterns, F.when(fired, 0.05).otherwise(0.95), rules), rules, false_alarm)
    for _ in range(sweeps):
        new = estimated(sums(patterns, posterior(params, rules), rules), rules, false_alarm)
        moved = max(abs(new[k] - params[k]) for k in params)
        params = new
        if moved < tolerance:
            removed(patterns)
            return params
    raise RuntimeError(f"estimates still move by {moved:.2g} after {sweeps} sweeps")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, keep_at: float = 0.5, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """doc_id, the counts, base_failed, posterior, kept. Counts are made once, then votes are counted
    and judged over the small table of counts."""
    small = persisted(features(docs, id_col, text_col), "quality")
    voted = votes(small, rules)
    params = fit(voted, rules)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return (
        voted.withColumn("base_failed", failed)
        .withColumn("posterior", posterior(params, rules))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    )
