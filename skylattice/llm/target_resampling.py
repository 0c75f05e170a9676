"""Resampling of documents towards a target distribution, by importance weights of hashed n-grams.

Runs of 1 to ``longest`` words (lower case for A to Z) fall into buckets by the crc32 of their bytes. Bucket shares of all
documents and of all target texts give each bucket a gain, the log ratio of its smoothed shares in thousandths; a
document's weight is the floored mean of its features' gains, and its score the weight plus Gumbel noise drawn from the
hash of its id, so that the highest scores are a sample without replacement by importance. The highest ``percent`` of the
documents that have ``min_words`` words are drawn and ranked.

N-grams are interned per batch in an open-addressed NumPy table (``gram_table``): the bucket is computed once per slot, its
count adds to the bucket counts, and the gains are gathered by every occurrence's slot.

Scale: two passes over the texts without a shuffle of them. At most ``buckets`` sums reach the driver. Scores are whole
numbers within some ten thousands, so the cut of the draw comes from a histogram of scores; only rows above the cut are put
in order, by range of score and id, and numbered by offsets of the ranges. Equal rows travel as one with a count.

Defined results: null and empty texts have no features and weight 0; a null id hashes as an empty one and ranks after all
other ids of its score; rows with equal score and id rank by fewer features first; repeated rows have ranks of their own;
without documents there is no row, without target texts the target's shares are even; a text of any length is taken as a
whole, its occurrences in blocks; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.llm.gram_table import Grams, blocks, tables
from skylattice.llm.storage import small_batches, written
from skylattice.llm.worker import released


@dataclass(frozen=True)
class Resampling:
    longest: int = 1
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 10
    seed: str = "2024"


def bucket_counts(texts: DataFrame, text_col: str, how: Resampling) -> np.ndarray:
    """Features of all ``texts`` by bucket."""

    def count(batches):
        total = np.zeros(how.buckets, dtype=np.int64)
        for batch in batches:
            for _, data, bounds in blocks(batch.column(0)):
                for _, table in tables(Grams(data, bounds, how.longest), how.buckets):
                    total += np.bincount(table.bucket, weights=table.count, minlength=how.buckets).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": found, "n": total[found]})

    small_batches(texts.sparkSession)
    rows = texts.select(F.col(text_col).cast("string")).mapInArrow(lambda batches: released(count(batches)), "bucket long, n long")
    out = np.zeros(how.buckets, dtype=np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():  # ``buckets`` rows at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, floored."""
    k, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratio = lambda s, t: (t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weighed(text: Column, gain: np.ndarray, how: Resampling, spark) -> Column:
    """Words, features and weight of a text column, as a struct."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(gain)  # ``buckets`` numbers

    def weigh(batches):
        for texts in batches:
            found = [pa.StructArray.from_arrays([pa.array([], pa.int64())] * 3, names=["n_words", "n_features", "weight"])]
            for n, data, bounds in blocks(texts):
                grams = Grams(data, bounds, how.longest)
                total = np.zeros(n, dtype=np.int64)
                features = np.bincount(grams.owner, minlength=n).astype(np.int64)
                for take, table in tables(grams, how.buckets):
                    total += np.bincount(grams.owner[take], weights=held.value[table.bucket][table.slot], minlength=n).astype(np.int64)
                weight = total // np.maximum(features, 1)  # numpy's // goes down
                found.append(pa.StructArray.from_arrays([pa.array(x) for x in (grams.words, features, weight)], names=["n_words", "n_features", "weight"]))
            yield pa.concat_arrays(found)

    @F.arrow_udf("struct<n_words: bigint, n_features: bigint, weight: bigint>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from released(weigh(batches))

    return of(text)


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, floored, from the hash of an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


_KEY = ["doc_id", "n_features", "weight", "score"]


def cut(scored: DataFrame, percent: int) -> tuple[int, int | None]:
    """How many rows are drawn, and the score of the last of them (None: no row is). The histogram has a row per score:
    gains and noise lie within some ten thousands whatever the table holds."""
    held = scored.groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()
    wanted = percent * sum(r["n"] for r in held) // 100
    above = 0
    for r in held:
        above += r["n"]
        if above >= wanted > 0:
            return wanted, r["score"]
    return wanted, None


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (distinct, with a count ``n``) with the rank of the first of each, by falling score, rising id and rising
    number of features, as ``first``."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def count(batches):
        before = 0
        for b in batches:
            n = b.column("n").to_numpy()
            ends = np.cumsum(n) + before
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - n)], names=[*b.schema.names, "before"])
            before = int(ends[-1]) if len(ends) else before

    counted = written(ranged.mapInArrow(count, ranged.schema.simpleString()[7:-1] + ",before:bigint"), "drawn")
    parts = counted.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # a row per shuffle partition
    offsets, total = {}, 0
    for r in parts:
        offsets[r["part"]] = total
        total += r["n"]
    at = F.create_map(*[F.lit(x) for p in offsets.items() for x in p])[F.col("part")] if offsets else F.lit(0)
    return counted.select(*_KEY, "n", (at + F.col("before") + 1).cast("long").alias("first"))


def resample(docs: DataFrame, target: DataFrame, how: Resampling = Resampling(), id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, and rank (null where it is not drawn)."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, text_col, how), bucket_counts(target, target_col, how))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), weighed(F.col(text_col).cast("string"), gain, how, spark).alias("found"))
    rows = rows.select("doc_id", (F.col("found.n_words") >= how.min_words).alias("fit"), "found.n_features", "found.weight", (F.col("found.weight") + noise(F.col("doc_id"), how.seed)).alias("score"))
    scored = written(rows, "scores")
    wanted, last = cut(scored.where("fit"), how.percent)
    if last is None:
        return scored.select(*_KEY, F.lit(None).cast("long").alias("rank"))
    high = F.col("fit") & (F.col("score") >= last)
    first = numbered(scored.where(high).groupBy(*_KEY).agg(F.count("*").alias("n")))
    ranked = first.select(*_KEY, F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("rank"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.unionByName(scored.where(~high).select(*_KEY, F.lit(None).cast("long").alias("rank")))


#: The same in DuckDB for single words, on ``documents`` and ``benchmark``; crc32 is computed byte by byte from its table.
SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8
),
crc AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8),
docs AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
aims AS (SELECT translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark),
worded AS (SELECT rid, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM docs),
aimed AS (SELECT unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM aims),
by_doc AS (SELECT rid, w, count(*) AS n FROM worded GROUP BY 1, 2),
kinds AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM worded UNION SELECT w FROM aimed)),
hashed AS (
  SELECT w, xor(list_reduce(list_transform(range(1, length(x), 2), lambda p: ('0x' || substr(x, CAST(p AS BIGINT), 2))::BIGINT),
                            lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
  FROM kinds, crc
),
source AS (SELECT bucket, sum(n) AS s FROM by_doc JOIN hashed USING (w) GROUP BY 1),
target AS (SELECT bucket, count(*) AS t FROM aimed JOIN hashed USING (w) GROUP BY 1),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM source)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM target)::DOUBLE AS t_all),
gained AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((s::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS gain
  FROM source LEFT JOIN target USING (bucket), sums
),
weighed AS (
  SELECT rid, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM by_doc JOIN hashed USING (w) JOIN gained USING (bucket) GROUP BY rid
),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weighed USING (rid)
),
ranked AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS place FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank FROM ranked
"""
