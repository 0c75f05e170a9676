"""Audit of how quality filters interact: what each removes in every order, and its fair share of all removals.

Whether a document fails a filter does not depend on the other filters, so an order of filters is decided by the pattern of
failures alone: documents are counted by part and pattern (at most 32 of them), and everything else works on those
counts. The documents that a coalition of filters removes make a game over the coalitions. Its Hart-Mas-Colell potential
is computed recursively, P(S) = (removed by S + sum of P(S without i)) / |S|; a filter's Shapley value is the potential
of all filters minus the potential without it. What a filter removes at a step of an order is the difference of two
coalitions. All potentials are kept 60 times as large, where 60 is a multiple of 1 to 5, so that they are whole numbers.

Filters: A under 100 words; B distinct words below 80 % of the words; C more than 10 % capitals; D a symbol of
``#$%&*|``; E the text of a smaller id again, anywhere in the table.

Scale: texts are read once and leave their scan as a digest. Equal digests meet as (id, digest, part) counts that were
summed before the shuffle, and only an id's own rows are joined, so that a text copied a billion times is no hot key.

Defined results: null text is an empty one, a null part the part ''; rows with a null id neither fail E nor make others
fail it, and have no labels; repeated rows count each, and do not fail E for each other; an id with several rows of labels
has a label that any of them has; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.llm.storage import written

FILTERS = "ABCDE"
_ALL = (1 << len(FILTERS)) - 1
#: A multiple of every size of a coalition.
_WHOLE = 60


def failures(text: Column) -> Column:
    """Bits 1, 2, 4 and 8 of the failures of A to D of a text that is not null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    bit = lambda fails, value: F.when(fails, F.lit(value)).otherwise(F.lit(0))
    return bit(n < 100, 1) + bit(100 * kinds.cast("long") < 80 * n.cast("long"), 2) + bit(100 * capitals.cast("long") > 10 * F.length(text).cast("long"), 4) + bit(text.rlike("[#$%&*|]"), 8)


def patterns(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Documents by part and pattern of failures: part, mask, n, good (labelled quality 1), toxic (labelled toxic 1)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), failures(F.col("text")).alias("mask"))
    rows = written(rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n")), "filters")

    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("first"))
    known = rows.where("id is not null").alias("r").join(first.alias("f"), (F.col("r.id") == F.col("f.first")) & (F.col("r.digest") == F.col("f.digest")), "left")
    again = F.when(F.col("first").isNull(), F.lit(16)).otherwise(F.lit(0))
    known = known.select("id", "part", (F.col("mask") + again).alias("mask"), "n").groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    marked = labels.select(F.col(id_col).cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marked = marked.groupBy("id").agg(F.coalesce(F.bool_or("good"), F.lit(False)).alias("good"), F.coalesce(F.bool_or("toxic"), F.lit(False)).alias("toxic"))
    known = known.join(marked, "id", "left").select("part", "mask", "n", *[F.when(F.col(c), F.col("n")).otherwise(F.lit(0)).alias(c) for c in ("good", "toxic")])
    nameless = rows.where("id is null").select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return known.unionByName(nameless).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def games(counts: DataFrame) -> DataFrame:
    """One row per part: its documents ``n``, and for each coalition (at the place of its bits) the documents that it
    removes (``removed``), the good and toxic ones among them, and the ``potential``."""
    coalitions = counts.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(_ALL))))
    hit = F.col("mask").bitwiseAND(F.col("s")) != 0
    lost = coalitions.groupBy("part", "s").agg(F.sum("n").alias("all"), *[F.sum(F.when(hit, F.col(c)).otherwise(F.lit(0))).alias(c) for c in ("n", "good", "toxic")])
    by_coalition = F.array_sort(F.collect_list(F.struct("s", "n", "good", "toxic")))  # 32 of them
    held = lost.groupBy("part").agg(F.max("all").alias("n"), by_coalition.alias("v"))
    held = held.select("part", "n", F.col("v.n").alias("removed"), F.col("v.good").alias("good"), F.col("v.toxic").alias("toxic"))
    return held.withColumn("potential", potentials(F.col("removed")))


def potentials(removed: Column) -> Column:
    """60 times the potential of every coalition, each from the coalitions with one filter less, which come before it."""
    bits = F.array(*[F.lit(1 << k) for k in range(len(FILTERS))])

    def next_one(known: Column, s: Column) -> Column:
        less = lambda total, bit: total + F.when(s.bitwiseAND(bit) != 0, known[s.bitwiseXOR(bit)]).otherwise(F.lit(0))
        total = F.aggregate(bits, _WHOLE * removed[s], less)
        return F.concat(known, F.array((total / F.bit_count(s)).cast("long")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_ALL)), F.array(F.lit(0).cast("long")), next_one)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step; counts of documents, and ``shapley``: what the step's filter
    removes at any step, summed over all orders."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    found = games(patterns(docs, labels, id_col, text_col, part_col))
    found = found.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ",")))
    found = found.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda letter: F.pow(F.lit(2), F.ascii(letter) - ord(FILTERS[0])).cast("int")
    before = F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(len(FILTERS))), lambda k: (k > 0) & (k < F.col("step"))), F.lit(0), lambda s, k: s + bit(F.substring("filter_order", k, F.lit(1))))
    found = found.withColumn("own", bit(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("before", before).withColumn("after", F.col("own") + F.col("before"))
    gained = lambda c: F.col(c)[F.col("after")] - F.col(c)[F.col("before")]
    without = F.lit(_ALL) - F.col("own")
    return found.select(
        "part",
        "filter_order",
        "step",
        (F.col("n") - F.col("removed")[F.col("after")]).alias("kept"),
        gained("removed").alias("removed"),
        (F.col("removed")[F.col("own")] - gained("removed")).alias("redundant"),
        (F.col("removed")[_ALL] - F.col("removed")[without]).alias("unique_fails"),
        gained("good").alias("good_lost"),
        gained("toxic").alias("toxic_lost"),
        ((F.col("potential")[_ALL] - F.col("potential")[without]) * F.lit(len(orders) // _WHOLE)).alias("shapley"),
    )


#: The same in DuckDB, on ``documents`` and ``labels``, without potentials: every order is applied to every pattern.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM docs),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT w.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
         {'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words),
          'C': 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text),
          'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > w.first, false)} AS f
  FROM worded w LEFT JOIN marks m ON w.doc_id = m.doc_id
),
counted AS (
  SELECT part, concat(CASE WHEN f.A THEN 'A' ELSE '' END, CASE WHEN f.B THEN 'B' ELSE '' END, CASE WHEN f.C THEN 'C' ELSE '' END,
                      CASE WHEN f.D THEN 'D' ELSE '' END, CASE WHEN f.E THEN 'E' ELSE '' END) AS failed,
         count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM fails GROUP BY 1, 2
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
hits AS (
  SELECT part, filter_order, step, filter_order[step] AS letter, n, good, toxic, failed, contains(failed, filter_order[step]) AS own,
         list_bool_or(list_transform(range(1, step), lambda k: contains(failed, filter_order[k]))) AS earlier
  FROM counted, steps
),
summed AS (
  SELECT part, filter_order, step, letter,
         sum(n) FILTER (NOT own AND NOT coalesce(earlier, false)) AS kept, sum(n) FILTER (own AND NOT coalesce(earlier, false)) AS removed,
         sum(n) FILTER (own AND coalesce(earlier, false)) AS redundant, sum(n) FILTER (failed = letter) AS unique_fails,
         sum(good) FILTER (own AND NOT coalesce(earlier, false)) AS good_lost, sum(toxic) FILTER (own AND NOT coalesce(earlier, false)) AS toxic_lost
  FROM hits GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, letter), 0) AS BIGINT) AS shapley
FROM summed
"""
