"""Positions, windows and brackets of long lines: right against plain Python, and in time that grows as the line does."""

import random
import re
import time

from pyspark.sql import functions as F

from docaudit.functions.text import at_hits, cut, hits, piece, spliced, window
from docaudit.operators import rules

SIGNS = "ab ,;()[]{}  .з\U0001F600"


def lines(sizes, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(n)) for n in sizes]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string")


def test_hits_and_windows(spark):
    texts = ["", "a", *lines([5, 255, 256, 257, 512, 1000, 5000])]
    around = at_hits(F.col("text"), " +[,;.]", lambda t, x: F.struct(
        x["pos"].alias("pos"), window(t, x["pos"], 20).alias("w"), spliced(t, x["pos"], 20, F.length(x["m"]), F.lit("#")).alias("s"), piece(t, x["pos"] + 3, 200).alias("p")))
    for row in table(spark, texts).select("text", hits(F.col("text"), " +[,;.]").alias("h"), around.alias("a")).collect():
        t, found = row.text, list(re.finditer(" +[,;.]", row.text))
        assert [(h.pos, h.m) for h in row.h] == [(m.start(), m.group()) for m in found]
        for m, a in zip(found, row.a or [], strict=True):
            at, start, end = m.start(), max(0, m.start() - 20), min(len(t), m.start() + 20)
            w = ("..." if start else "") + t[start:end] + ("..." if end < len(t) else "")
            k = at - start + (3 if start else 0)
            assert (a.pos, a.w, a.s, a.p) == (at, w, w[:k] + "#" + w[k + len(m.group()):], t[at + 3 : at + 203])


def by_one_stack(text):
    """The walk with a single stack of all kinds."""
    stack, errors, opens = [], [], dict(zip(")]}", "([{", strict=True))
    for i, c in enumerate(text):
        if c in "([{":
            stack.append((c, i))
        elif c in opens:
            token = text[:i].rsplit("\n", 1)[-1].strip()
            if not stack and c == ")" and (re.fullmatch(r"\d+", token) or re.fullmatch(r"[^\W\d_]", token)):
                continue
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == opens[c]), None)
            if k is None:
                errors.append(("orphan_close", i, None))
            else:
                if k != len(stack) - 1:
                    errors.append(("crossed", i, stack[k][1]))
                del stack[k]
    return errors + [("unclosed_open", i, i) for _, i in stack]


def test_brackets_as_with_one_stack(spark):
    texts = ["([)]", "([])", "({]}", "1) a", "a) b)", ")", ") )", *lines([3, 10, 40, 300, 700, 2500] * 4, seed=8)]
    for row in table(spark, texts).select("text", rules.bracket_errors(F.col("text")).alias("e")).collect():
        assert [(e.kind, e.pos, e.open_pos) for e in row.e] == by_one_stack(row.text)
        assert all(e.close is None or e.kind == "unclosed_open" or row.text[e.pos] == e.close for e in row.e)


def test_cost_grows_with_the_line(spark):
    """A line of 80,000 signs, nearly all of them matches, costs a few times what one of 20,000 does."""
    made = rules.merged([rules.spacing(F.col("text")), rules.semicolons(F.col("text"))])

    def seconds(n):
        x = table(spark, ["a ,b ( c ) [d;e " * (n // 16)]).select(made.alias("f"), rules.bracket_errors(F.col("text")).alias("e"))
        x.write.format("noop").mode("overwrite").save()
        start = time.time()
        x.write.format("noop").mode("overwrite").save()
        return time.time() - start

    small, large = seconds(20_000), seconds(80_000)
    assert large < 10 * small + 1 and large < 30


def test_cut_of_nothing(spark):
    row = table(spark, ["", None]).select(cut(F.col("text")).alias("c"), window(cut(F.col("text")), F.lit(0), 5).alias("w")).collect()
    assert row[0].w == row[1].w == ""
