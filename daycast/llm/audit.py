"""Filter interaction audit: min-plus removal ranks.

Every document gets a mask, one bit per filter it fails. A mask is a row of a matrix
M with 0 where the filter fails it and infinity elsewhere; an order of filters is a
row of P, its inverse permutation, holding every filter's position. The min-plus
product min over f of (M[mask, f] + P[order, f]) is the step at which a document of
that mask is removed under that order. It depends on the mask alone, so Spark counts
documents per (part, mask), and a part's table of all orders and steps is a scatter
of at most 2 ** filters counts by that matrix.

``flags`` reads each text once, with built-in functions, into a narrow row (id, part,
mask, SHA-256 of the text), written to the checkpoint folder. Copies: the smallest id
of every text is found by a grouped minimum (combined before the shuffle, so a group of
any size is one row a task), and rows are joined with it on id and text hash together,
so that no group of copies meets in one task.

Cases: a null text is an empty one, a null part the empty string (with rows of that
part if there are any); a row with a null id is a document, has no label, is no copy
and makes none; rows of one id are documents each, and copies of a smaller id only;
several labels of an id count when any does, a null label not; equal text means equal
SHA-256; an empty table gives an empty result; other columns are neither read nor
returned.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daycast.llm.common import arrow_map, stored

# The filters' limits.
LEAST_WORDS = 50
LEAST_DISTINCT = 65         # of a hundred words
MOST_CAPITALS = 5           # of a hundred code points
SYMBOLS = "[#$%&*|]"
GAP = r"[\x20\x09-\x0D]+"
NAMES = "ABCDE"             # A: short, B: repetitive, C: capitals, D: symbols, E: copy


def text_filters(text: Column) -> list[Column]:
    """Failure conditions A to D of a text that is not null."""
    words = F.array_remove(F.split(text, GAP), "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [F.size(words) < LEAST_WORDS,
            100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
            100 * capitals.cast("long") > MOST_CAPITALS * F.char_length(text).cast("long"),
            text.rlike(SYMBOLS)]


def flags(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, mask, good, toxic): mask has bit i for the i-th of ``NAMES``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.shiftleft(c.cast("int"), i) for i, c in enumerate(text_filters(text))]
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                           F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                           sum(bits[1:], bits[0]).alias("mask"), F.unhex(F.sha2(text, 256)).alias("same")), "flags")
    named = rows.where("doc_id IS NOT NULL")
    first = named.groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *[F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))).alias(name)
          for c, name in (("quality", "good"), ("toxic", "toxic"))])
    copy = 1 << NAMES.index("E")
    out = (named.join(first, ["doc_id", "same"], "left").join(marks, "doc_id", "left")
           .select("doc_id", "part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(copy)).alias("mask"),
                   F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))
    return out.unionByName(rows.where("doc_id IS NULL").select(
        "doc_id", "part", "mask", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic")))


def removal_steps(filters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(orders, fails, steps): all orders; filters a mask fails, masks x filters; and
    the step, counted from 0, that removes a mask under an order, masks x orders
    (``filters``: none does)."""
    orders = np.array(list(itertools.permutations(range(filters))))
    position = np.argsort(orders, axis=1)
    fails = (np.arange(1 << filters)[:, None] >> np.arange(filters)) & 1 == 1
    steps = (np.where(fails, 0, filters)[:, None, :] + position[None]).min(axis=2)
    return orders, fails, np.minimum(steps, filters)


def tables(weights: np.ndarray, filters: int) -> dict[str, np.ndarray]:
    """Counts of parts x orders x steps from weights of parts x masks x (documents,
    good, toxic)."""
    orders, fails, steps = removal_steps(filters)
    parts, every = len(weights), np.arange(len(orders))
    gone = np.zeros((parts, len(orders), filters + 1, weights.shape[2]), np.int64)
    for mask, step in enumerate(steps):             # a mask goes to one step of each order
        gone[:, every, step] += weights[:, mask, None]
    gone = gone[:, :, :filters]
    n = weights[:, :, 0]
    removed = gone[..., 0]
    failing = n @ fails                             # parts x filters
    alone = n[:, 1 << np.arange(filters)]
    shapley = np.zeros((parts, filters), np.int64)
    for f in range(filters):
        shapley[:, f] = removed[:, orders == f].sum(axis=1)
    return {"kept": n.sum(axis=1)[:, None, None] - np.cumsum(removed, axis=2), "removed": removed,
            "redundant": failing[:, orders] - removed, "unique_fails": alone[:, orders],
            "good_lost": gone[..., 1], "toxic_lost": gone[..., 2], "shapley": shapley[:, orders]}


def interactions(flagged: DataFrame, names: str = NAMES) -> DataFrame:
    """One row per part, order of the filters and step, from ``flags``' columns."""
    filters = len(names)
    counts = flagged.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    # at most 2 ** filters rows a part
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    orders, _, _ = removal_steps(filters)
    text = np.array(["".join(names[f] for f in o) for o in orders], object)
    cells = len(orders) * filters

    def rows(batch: pa.RecordBatch) -> dict:
        weights = np.zeros((batch.num_rows, 1 << filters, 3), np.int64)
        for k, masks in enumerate(batch.column("masks").to_pylist()):
            for m in masks:
                weights[k, m["mask"]] += (m["n"], m["good"], m["toxic"])
        out = {c: v.reshape(-1) for c, v in tables(weights, filters).items()}
        n = batch.num_rows
        return {"part": batch.column("part").take(pa.array(np.repeat(np.arange(n), cells))),
                "filter_order": np.tile(np.repeat(text, filters), n),
                "step": np.tile(np.arange(1, filters + 1, dtype=np.int32), n * len(orders)),
                "filter": np.tile(np.array(list(names), object)[orders].reshape(-1), n), **out}

    return arrow_map(parts, rows, "part string, filter_order string, step int, filter string, kept long, "
                     "removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, "
                     "shapley long")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    return interactions(flags(docs, labels, part))


def _sql() -> str:
    fails = {"A": f"len(words) < {LEAST_WORDS}",
             "B": f"100 * len(list_distinct(words)) < {LEAST_DISTINCT} * len(words)",
             "C": f"100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t)",
             "D": f"regexp_matches(t, '{SYMBOLS}')",
             "E": "coalesce(texts.doc_id > first_id, false)"}
    step = ", ".join(f"CASE WHEN m.{c} THEN strpos(o.filter_order, '{c}') ELSE 99 END" for c in fails)
    here = "CASE g.filter " + " ".join(f"WHEN '{c}' THEN x.{c}" for c in fails) + " END"
    others = " AND ".join(f"(g.filter = '{c}') = x.{c}" for c in fails)
    total = lambda what, cond: f"CAST(coalesce(sum(x.{what}) FILTER ({cond}), 0) AS BIGINT)"
    return f"""WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
flagged AS (
  SELECT part, {", ".join(f"{v} AS {k}" for k, v in fails.items())},
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM texts LEFT JOIN marks ON texts.doc_id = marks.doc_id),
masks AS (
  SELECT part, A, B, C, D, E, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM flagged GROUP BY part, A, B, C, D, E),
letters(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order
  FROM letters a JOIN letters b ON b.c <> a.c JOIN letters c ON c.c NOT IN (a.c, b.c)
  JOIN letters d ON d.c NOT IN (a.c, b.c, c.c) JOIN letters e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
x AS (
  SELECT m.*, o.filter_order, least({step}) AS gone FROM masks m CROSS JOIN orders o),
g AS (
  SELECT part, filter_order, s AS step, substr(filter_order, s, 1) AS filter
  FROM (SELECT DISTINCT part FROM masks) CROSS JOIN orders CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
cells AS (
  SELECT g.part, g.filter_order, CAST(g.step AS INTEGER) AS step, g.filter,
         {total("n", "x.gone > g.step")} AS kept, {total("n", "x.gone = g.step")} AS removed,
         {total("n", f"{here} AND x.gone < g.step")} AS redundant, {total("n", others)} AS unique_fails,
         {total("good", "x.gone = g.step")} AS good_lost, {total("toxic", "x.gone = g.step")} AS toxic_lost
  FROM g JOIN x ON x.part = g.part AND x.filter_order = g.filter_order
  GROUP BY g.part, g.filter_order, g.step, g.filter)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM cells"""


SQL = _sql()
