"""Audit of filters that interact: what every filter removes at every place of every order.

One scan gives each document the set of filters it fails, as bits; documents are then only counts per (part, bits). All
orders are enumerated by a recursive common table expression over the mask cells: each level extends the prefixes of
filters by the unused letters, carries the bits that were applied, and says what the new step does to each cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

SPACES = r"[\x20\x09-\x0D]+"
#: Metrics of a step that count documents.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_filters(text: str = "text") -> dict[str, Column]:
    """Failure conditions on a text: few words, repeated words, capitals, odd signs."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, SPACES), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * F.regexp_count(t, F.lit("[A-Z]")) > 10 * F.length(t),
        "D": t.rlike("[#$%&*|]"),
    }


def mask_cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], duplicate: str | None = None, part: str = "lang",
               doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, mask, docs, good, toxic): documents by part and failed filters (bit k of ``mask`` is the k-th letter), with how
    many of them ``labels`` calls of good quality or toxic.

    ``duplicate`` names a further filter that a text fails if a row of a smaller doc_id has the same text. Equal texts meet
    as digests whose rows were counted before, so a group of copies costs one row per task, whatever its size.
    """
    letters = sorted([*filters, *([duplicate] if duplicate else [])])
    bit = {letter: 1 << k for k, letter in enumerate(letters)}
    mask = sum((F.when(fails, bit[letter]).otherwise(0) for letter, fails in filters.items()), F.lit(0))
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(t, 256)).alias("digest"), mask.alias("mask"))
    once = rows.groupBy("id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    named = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("is_good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("is_toxic"))
    # Rows without an id meet no label; a salt keeps them from one task.
    salted = once.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)))
    met = salted.join(named.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left").select(
        "id", "part", "digest", "mask", "n", F.coalesce("is_good", F.lit(False)).alias("is_good"), F.coalesce("is_toxic", F.lit(False)).alias("is_toxic"))
    if duplicate:
        held = F.col("id").isNotNull()
        groups = met.groupBy("digest", "part", "mask", "is_good", "is_toxic").agg(
            F.sum("n").alias("n"), F.sum(F.when(held, F.col("n")).otherwise(0)).alias("n_id"),
            F.min(F.when(held, F.struct("id", "n"))).alias("least"))
        first = F.min("least.id").over(Window.partitionBy("digest"))
        failing = F.col("n_id") - F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0)
        met = groups.withColumn("failing", F.coalesce(failing, F.lit(0))).select("part", "is_good", "is_toxic", F.explode(F.array(
            F.struct((F.col("mask") + bit[duplicate]).alias("mask"), F.col("failing").alias("n")),
            F.struct("mask", (F.col("n") - F.col("failing")).alias("n")))).alias("c")).select("part", "is_good", "is_toxic", "c.mask", "c.n").where("n > 0")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return met.groupBy("part", "mask").agg(F.sum("n").alias("docs"), count(F.col("is_good")).alias("good"), count(F.col("is_toxic")).alias("toxic"))


def walk_orders(cells: DataFrame, letters: list[str]) -> DataFrame:
    """(mask, prefix, letter, step, and what the step does to the cell) for every prefix of every order of the letters."""
    unused = ", ".join(f"named_struct('letter', '{c}', 'bit', {1 << k})" for k, c in enumerate(letters))
    return cells.sparkSession.sql(f"""
WITH RECURSIVE walk (mask, prefix, letter, bit, before, applied, step) AS (
  SELECT mask, CAST('' AS STRING), CAST('' AS STRING), 0, 0, 0, 0 FROM (SELECT DISTINCT mask FROM {{cells}})
  UNION ALL
  SELECT mask, concat(prefix, f.letter), f.letter, f.bit, applied, applied | f.bit, step + 1
  FROM (SELECT mask, prefix, applied, step, explode(filter(array({unused}), f -> applied & f.bit = 0)) AS f FROM walk WHERE step < {len(letters)})
)
SELECT mask, prefix, letter, step, mask & applied = 0 AS kept, mask & before = 0 AND mask & bit <> 0 AS removed,
       mask & before <> 0 AND mask & bit <> 0 AS redundant, mask = bit AS unique_fails
FROM walk WHERE step > 0""", cells=cells)


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, duplicate: str | None = "E", part: str = "lang",
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What each filter does at each step of each order, by part.

    One row per part, filter_order (a permutation of the letters, applied from left to right) and step: ``letter``, documents
    kept after the step, removed by it, redundant (failing it but removed before), unique_fails (failing nothing else),
    good_lost and toxic_lost (removed by it, labelled so), and shapley (removed by the letter over all orders).

    Null text is the empty text, null part the empty string. Rows without a doc_id are counted, are no copies of others and
    make no others copies; repeated rows of one doc_id are counted each, and do not make each other copies. A document is
    good (toxic) if any of its label rows says so. Empty ``docs`` give no rows. Columns beside the named ones are ignored.
    """
    filters = text_filters(text) if filters is None else filters
    letters = sorted([*filters, *([duplicate] if duplicate else [])])
    cells = stored(mask_cells(docs, labels, filters, duplicate, part, doc_id, text), "mask-cells")
    walk = walk_orders(cells, letters)  # at most 2^letters cells times the prefixes of the orders: 10,400 rows for five letters
    steps = cells.join(F.broadcast(walk), "mask").groupBy("part", "prefix", "letter", "step").agg(
        *[F.sum(F.when(F.col(k), F.col("docs")).otherwise(0)).alias(k) for k in COUNTS[:4]],
        *[F.sum(F.when(F.col("removed"), F.col(k)).otherwise(0)).alias(f"{k}_lost") for k in ("good", "toxic")])
    ways = F.element_at(F.array(*[F.lit(math.factorial(len(letters) - k)) for k in range(1, len(letters) + 1)]), F.col("step"))
    steps = steps.withColumn("shapley", F.sum(F.col("removed") * ways).over(Window.partitionBy("part", "letter")))
    # Every whole order with its prefixes: one per permutation and step.
    orders = walk.where(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    orders = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    orders = orders.select("filter_order", F.expr("left(filter_order, step)").alias("prefix"))
    return steps.join(F.broadcast(orders), "prefix").select("part", "filter_order", "step", "letter", *COUNTS, "shapley")
