"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probability.

Documents fall into cells of source, language and topic. Cells' token weights are raked, one dimension
after another, until each dimension's sums follow its target marginals; a document of a cell is kept
with the probability that makes the expected tokens of the cell its raked weight, scaled so
that `share` of all tokens are expected, probabilities cut at 1 and the excess dealt to the others. All of it is DataFrame functions: cells are one sum over the documents, the
raking runs over that small table, the draw is a hash of id and text.

Targets: a marginal of a dimension is its share of tokens to the power of `temper` (1 keeps it as it
is, 0 makes all equal) unless given by value; given ones are scaled to what the others leave.

Topic: the genre that a text's form shows (topic_of): markup, capitals, listing, long or prose.

Defined results: null source or language is a value of its own ('' in the result); null or blank text
has no tokens and weighs one; rows with equal id and text are drawn alike; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.llm.common import SPACE, persisted, removed, unused

SWEEPS = 12
DIMENSIONS = ("source", "lang", "topic")
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}


def topic_of(text: Column) -> Column:
    """markup: 5 % of characters are symbols; capitals: 30 % are A-Z; listing: a line break for every
    60 characters; long: 8000 characters or more; prose otherwise."""
    n = F.length(text)
    marks = n - F.length(F.translate(text, "#*$%&|<>", ""))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    breaks = n - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (
        F.when(20 * marks >= F.greatest(n, F.lit(1)), "markup").when(10 * capitals >= 3 * F.greatest(n, F.lit(1)), "capitals")
        .when(60 * breaks >= F.greatest(n, F.lit(1)), "listing").when(n >= 8000, "long").otherwise("prose")
    )


def draw_of(id_: Column, text: Column) -> Column:
    """A number in [0, 1) that id and text decide: 52 bits of an MD5."""
    key = F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rake(cells: DataFrame, temper: dict[str, float], given: dict[str, dict[str, float]] | None = None, sweeps: int = SWEEPS) -> DataFrame:
    """cells (source, lang, topic, tokens) -> the same with weight: raked tokens, of the same total."""
    every = Window.partitionBy()
    x = cells.withColumn("total", F.sum("tokens").over(every)).withColumn("weight", F.col("tokens").cast("double"))
    for d in DIMENSIONS:
        by = Window.partitionBy(d)
        mass = F.pow(F.sum("tokens").over(by) / F.col("total"), F.lit(float(temper[d])))
        wanted = (given or {}).get(d)
        if wanted:
            left = max(0.0, 1 - sum(wanted.values()))
            x = x.withColumn("_m", mass).withColumn("_g", F.col(d).isin(*wanted))
            # each value counts once in its dimension's total
            x = x.withColumn("_n", F.count("*").over(by))
            others = F.sum(F.when(F.col("_g"), F.lit(0.0)).otherwise(F.col("_m") / F.col("_n"))).over(every)
            pick = F.element_at(F.create_map(*[F.lit(y) for kv in wanted.items() for y in kv]), F.col(d))
            x = x.withColumn(f"t_{d}", F.when(F.col("_g"), pick).otherwise(left * F.col("_m") / others)).drop("_m", "_g", "_n")
        else:
            x = x.withColumn("_m", mass).withColumn("_n", F.count("*").over(by))
            x = x.withColumn(f"t_{d}", F.col("_m") / F.sum(F.col("_m") / F.col("_n")).over(every)).drop("_m", "_n")
    x = persisted(x, "rake")
    for _ in range(sweeps):
        for d in DIMENSIONS:
            x = x.withColumn("weight", F.col("weight") * F.col("total") * F.col(f"t_{d}") / F.sum("weight").over(Window.partitionBy(d)))
        old, x = x, persisted(x.coalesce(1), "rake")
        removed(old)
    return x.select(*DIMENSIONS, "tokens", "weight", *[f"t_{d}" for d in DIMENSIONS])


def _named(id_col: str, text_col: str, source_col: str, lang_col: str) -> dict[str, Column]:
    """A document's cell, tokens and draw."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {
        "__source": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "__lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")),
        "__topic": topic_of(text), "__tokens": F.greatest(F.size(F.array_remove(F.split(text, SPACE, -1), "")), F.lit(1)).cast("long"),
        "__draw": draw_of(F.col(id_col), F.col(text_col)),
    }


def _weights(named: DataFrame, temper: dict[str, float] | None, given: dict | None, share: float, sweeps: int) -> DataFrame:
    """__source, __lang, __topic, weight, probability of every cell of the named documents."""
    cells = named.groupBy(*[F.col(f"__{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("__tokens").alias("tokens"))
    done = persisted(calibrate(rake(cells, temper or TEMPER, given, sweeps), share), "weights")
    return done.select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], F.col("weight").alias("__weight"), F.col("probability").alias("__probability"))


CELL = [f"__{d}" for d in DIMENSIONS]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
        temper: dict[str, float] | None = None, given: dict | None = None, share: float = 0.6, sweeps: int = SWEEPS) -> DataFrame:
    """One row for each document: doc_id, source, lang, topic, n_tokens, weight (raked over raw tokens of
    its cell), probability, draw, kept, text_digest."""
    named = _named(id_col, text_col, source_col, lang_col)
    small = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in named.items()], F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_digest"))
    small = persisted(small, "mixing")
    return small.join(_weights(small, temper, given, share, sweeps), CELL).select(
        "doc_id", *[F.col(f"__{d}").alias(d) for d in DIMENSIONS], F.col("__tokens").alias("n_tokens"), F.round("__weight", 6).alias("weight"),
        F.round("__probability", 6).alias("probability"), F.round("__draw", 9).alias("draw"), (F.col("__draw") < F.col("__probability")).alias("kept"), "text_digest",
    )


def sampled(docs: DataFrame, temper: dict[str, float] | None = None, given: dict | None = None, share: float = 0.8, sweeps: int = SWEEPS) -> DataFrame:
    """The rows of docs that the calibrated draw keeps."""
    made = _named("doc_id", "text", "source", "lang")
    own = dict(zip(made, unused(docs, *made)))
    named = docs.withColumns({own[k]: c for k, c in made.items()})
    cells = _weights(named.select(*[F.col(own[k]).alias(k) for k in (*CELL, "__tokens")]), temper, given, share, sweeps)
    (p,) = unused(named, "__probability")
    cells = cells.select(*[F.col(k).alias(own[k]) for k in CELL], F.col("__probability").alias(p))
    kept = named.join(cells, [own[k] for k in CELL]).where(F.col(own["__draw"]) < F.col(p))
    return kept.select(*docs.columns)


def calibrate(raked: DataFrame, share: float) -> DataFrame:
    """Adds ratio = weight / tokens as `weight` and the probability min(1, c ratio), with c such that the
    expected tokens are `share` of all. With the cells in descending ratio, the first m have probability
    1 and the rest share what is left; m is the least for which the next probability is at most 1."""
    whole = Window.partitionBy()
    order = Window.partitionBy().orderBy(F.desc("ratio"), *DIMENSIONS)
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    x = raked.withColumn("ratio", F.col("weight") / F.col("tokens"))
    x = x.withColumn("full", F.coalesce(F.sum("tokens").over(ahead), F.lit(0))).withColumn(
        "rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0))
    )
    x = x.withColumn("c", (share * F.sum("tokens").over(whole) - F.col("full")) / F.col("rest"))
    x = x.withColumn("c", F.max(F.when(F.col("c") * F.col("ratio") <= 1, F.col("c"))).over(whole))
    return x.select(*DIMENSIONS, "tokens", F.col("ratio").alias("weight"), F.least(F.lit(1.0), F.coalesce(F.col("c") * F.col("ratio"), F.lit(1.0))).alias("probability"), *[f"t_{d}" for d in DIMENSIONS])


def oracle_sql(sweeps: int = SWEEPS, share: float = 0.6, temper: dict[str, float] = TEMPER) -> str:
    """The query with its default targets as DuckDB SQL."""
    words = "greatest(len(list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')), 1)"
    marks = "(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))"
    parts = [f"""named AS (
 SELECT doc_id, source, lang, CASE WHEN 20 * {marks} >= greatest(length(t), 1) THEN 'markup'
   WHEN 10 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) >= 3 * greatest(length(t), 1) THEN 'capitals'
   WHEN 60 * (length(t) - length(replace(t, chr(10), ''))) >= greatest(length(t), 1) THEN 'listing'
   WHEN length(t) >= 8000 THEN 'long' ELSE 'prose' END AS topic,
  CAST({words} AS BIGINT) AS n_tokens, md5(t) AS text_digest,
  CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(t)), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0 AS draw
 FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents))""",
        "cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM named GROUP BY ALL)",
        "total AS (SELECT sum(tokens) AS total FROM cells)"]
    for d in DIMENSIONS:
        parts.append(f"m_{d} AS (SELECT {d}, pow(sum(tokens) / (SELECT total FROM total), {temper[d]}) AS m FROM cells GROUP BY {d})")
        parts.append(f"g_{d} AS (SELECT {d}, m / (SELECT sum(m) FROM m_{d}) AS g FROM m_{d})")
    parts.append("w0 AS MATERIALIZED (SELECT *, tokens AS w FROM cells)")
    k = 0
    for _ in range(sweeps):
        for d in DIMENSIONS:
            parts.append(f"w{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, w * (SELECT total FROM total) * g / sum(w) OVER (PARTITION BY {d}) AS w FROM w{k} JOIN g_{d} USING ({d}))")
            k += 1
    parts.append(f"r1 AS (SELECT *, w / tokens AS ratio FROM w{k})")
    parts.append("r2 AS (SELECT *, coalesce(sum(tokens) OVER o, 0) AS full_, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest FROM r1 WINDOW o AS (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
    parts.append(f"r3 AS (SELECT *, ({share} * sum(tokens) OVER () - full_) / rest AS c FROM r2)")
    parts.append("r4 AS (SELECT *, max(CASE WHEN c * ratio <= 1 THEN c END) OVER () AS c1 FROM r3)")
    parts.append("r5 AS (SELECT source, lang, topic, ratio, least(1.0, coalesce(c1 * ratio, 1.0)) AS p FROM r4)")
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, source, lang, topic, n_tokens, round(ratio, 6) AS weight, round(p, 6) AS probability, round(draw, 9) AS draw, draw < p AS kept, text_digest
FROM named JOIN r5 USING (source, lang, topic)"""
