"""Operator 11: what five filters remove in every order, by difference arrays over the orders' Lehmer ranks.

Orders are ranked lexicographically, so that those which begin with the same letters are neighbours. A document
fails a set of filters, its mask; it is removed at step k where the first k - 1 letters pass it and the k-th does
not. Orders with such a beginning form one interval of ranks.

1. Each document becomes a narrow row with its mask; earlier copies of a text are found by the least id of its hash.
2. Documents are counted by part, mask and labels: from here on the input's size plays no part.
3. Each mask's intervals add its counts at their first rank and take them away behind their last; running sums
   over the 120 ranks are the documents removed at each step of each order.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiray.llm.common import WORD, cut_lineage

FILTERS = "ABCDE"
ORDERS = factorial(len(FILTERS))
#: fixed values of the filters
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SIGNS = r"[#$%&*|]"
_COUNTS = ("n", "good", "toxic")


def rank(order: str) -> int:
    """The Lehmer rank of an order: for each letter, how many smaller ones are still to come."""
    return sum(sum(later < letter for later in order[k + 1 :]) * factorial(len(order) - 1 - k) for k, letter in enumerate(order))


def intervals(mask: int) -> list[tuple[int, int, int]]:
    """(step, first rank, rank behind the last) of the orders that remove a document which fails the filters of a mask."""
    fails = [f for k, f in enumerate(FILTERS) if mask >> k & 1]
    passes = [f for f in FILTERS if f not in fails]
    out = []
    for k in range(len(passes) + 1):
        for before in permutations(passes, k):
            for f in fails:
                rest = sorted(set(FILTERS) - {*before, f})
                first = rank("".join((*before, f, *rest)))
                out.append((k + 1, first, first + factorial(len(rest))))
    return out


def _failures(text: Column) -> Column:
    """Bits of the first four filters that a text fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))[0]


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, text_hash, mask (the first four filters) of every row."""
    text = F.coalesce("text", F.lit(""))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("text_hash"),
        _failures(text).alias("of"), (100 * capitals.cast("long") > MOST_CAPITALS * F.length(text)).alias("capitals"), text.rlike(SIGNS).alias("signs"),
    )
    bits = [F.col("of.words") < LEAST_WORDS, 100 * F.col("of.distinct").cast("long") < LEAST_DISTINCT * F.col("of.words"), F.col("capitals"), F.col("signs")]
    mask = sum((F.when(bit, 1 << k).otherwise(0) for k, bit in enumerate(bits)), F.lit(0))
    return counted.select("doc_id", "part", "text_hash", mask.alias("mask"))


def counted_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail; good and toxic ones by their labels."""
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")
    )
    # repeated rows become one with their number; then copies of a text with the same marks become one, with the least
    # id and how many rows have it. All of it combines before the shuffles, however often a text or an id comes
    rows = masked(docs).groupBy("doc_id", "part", "text_hash", "mask").agg(F.count(F.lit(1)).alias("n"))
    labelled = rows.join(marks, F.col("doc_id") == F.col("_id"), "left")
    mark = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    copies = labelled.groupBy("text_hash", "part", "mask", *mark).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null")
    )
    # a text has as many of these rows as parts and marks, so that its window is small
    least = F.min("least").over(Window.partitionBy("text_hash"))
    originals = F.col("n_null") + F.when(F.col("least") == F.col("_first"), F.col("n_least")).otherwise(0)
    split = copies.withColumn("_first", least).withColumn("_originals", originals)
    copied = 1 << FILTERS.index("E")
    both = F.inline(F.array(F.struct(F.col("mask"), F.col("_originals").alias("n")), F.struct((F.col("mask") + copied).alias("mask"), (F.col("n") - F.col("_originals")).alias("n"))))
    by_mark = split.select("part", "good", "toxic", both).filter("n > 0")
    return by_mark.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col(c) * F.col("n")).alias(c) for c in ("good", "toxic")])


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    Parts are the values of `lang`; null and empty ones are the empty string. Null texts count as empty: they fail A, and E
    where an earlier document is empty or null. A row without an id is later than none and is a copy of none; it
    makes no other row a copy. Rows of one id are no copies of each other. A document labelled more than once is good
    or toxic if one of its labels says so; null labels say neither. Other columns are ignored. An empty table gives no rows."""
    spark = docs.sparkSession
    counts = cut_lineage(counted_masks(docs, labels))
    steps = [(m, *i) for m in range(1, 1 << len(FILTERS)) for i in intervals(m)]
    known = F.broadcast(spark.createDataFrame(steps, "mask int, step int, first int, behind int"))  # some hundred rows, whatever the input
    ends = F.inline(F.array(F.struct(F.col("first").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("behind").alias("rank"), F.lit(-1).alias("sign"))))
    changes = counts.join(known, "mask").select("part", "step", *_COUNTS, ends).filter(F.col("rank") < ORDERS)
    changes = changes.groupBy("part", "step", "rank").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in _COUNTS])
    names = spark.createDataFrame([(rank("".join(o)), "".join(o)) for o in permutations(FILTERS)], "_rank int, filter_order string")
    parts = counts.groupBy("part").agg(
        F.sum("n").alias("_all"),
        F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(1 << k) > 0, F.col("n")).otherwise(0)) for k in range(len(FILTERS))]).alias("_fails"),
        F.array(*[F.sum(F.when(F.col("mask") == 1 << k, F.col("n")).otherwise(0)) for k in range(len(FILTERS))]).alias("_only"),
    )
    # every rank and step of every part, then running sums: over the ranks of a step, and over the steps of an order
    grid = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("rank")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    over_ranks = Window.partitionBy("part", "step").orderBy("rank")
    over_steps = Window.partitionBy("part", "rank").orderBy("step")
    removed = grid.join(changes, ["part", "rank", "step"], "left").select("part", "rank", "step", *[F.coalesce(F.sum(c).over(over_ranks), F.lit(0)).alias(c) for c in _COUNTS])
    removed = removed.withColumn("_so_far", F.sum("n").over(over_steps))
    named = removed.join(F.broadcast(names), F.col("rank") == F.col("_rank")).join(parts, "part")
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    place = F.instr(F.lit(FILTERS), letter)
    by_filter = Window.partitionBy("part", "_letter")  # a row for each order
    return (
        named.withColumn("_letter", letter)
        .withColumn("_failed", F.element_at("_fails", place))
        .select(
            "part", "filter_order", "step", (F.col("_all") - F.col("_so_far")).alias("kept"), F.col("n").alias("removed"), (F.col("_failed") - F.col("n")).alias("redundant"),
            F.element_at("_only", place).alias("unique_fails"), F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("n").over(by_filter).alias("shapley"),
        )
    )


def oracle_sql() -> str:
    """The same by trying all orders on each mask."""
    return """
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), firsts AS (
  SELECT t, min(doc_id) AS first FROM texts GROUP BY t
), marks AS (
  SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id
), words AS (
  SELECT x.*, regexp_extract_all(x.t, '[^\\x20\\x09-\\x0D]+') AS w, f.first FROM texts x JOIN firsts f ON x.t = f.t
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN words.doc_id > first THEN 'E' ELSE '' END) AS fails
  FROM words LEFT JOIN marks ON words.doc_id = marks.doc_id
), masks AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), removal AS (
  SELECT part, o, fails, n, good, toxic, list_min(list_transform(range(1, 6), lambda k: CASE WHEN contains(fails, o[k]) THEN k ELSE 9 END)) AS stage
  FROM masks, orders
), steps AS (
  SELECT part, o AS filter_order, s.k AS step, o[s.k] AS letter,
         sum(CASE WHEN stage > s.k THEN n ELSE 0 END) AS kept, sum(CASE WHEN stage = s.k THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN stage < s.k AND contains(fails, o[s.k]) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = o[s.k] THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN stage = s.k THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN stage = s.k THEN toxic ELSE 0 END) AS toxic_lost
  FROM removal, (SELECT unnest(range(1, 6)) AS k) s GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
FROM steps
"""
