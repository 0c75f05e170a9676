"""Quality rules on documents and on lines that recur across documents.

Rules on the document alone: too few words, or too many words in repeated three-word windows. Then lines, normalised
(lower case, white space as one space, digits as 0) and hashed, are counted over the distinct texts of each host; a line
in more than ``share`` of the host's texts, and in at least ``least`` of them, is boilerplate and is removed. A document
left with fewer than ``min_words`` words, or with less than ``min_left`` of its words, is depleted and rejected.

Copies of one text count as one document of the host, so a text that was copied often does not lose its own lines.
A line's count is summed from partial sums of each task; hot lines and hot hosts meet no single task.

Defined results: null text is an empty one and fails for its few words; null is a host of its own; repeated rows are
judged each on their own; documents that fail the first rules count among their host's texts all the same.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.storage import small_batches, written

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_DIGITS = re.compile(r"[0-9]")


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeated: float = 0.5  # of the words, in three-word windows found twice or more
    share: float = 0.02
    least: int = 10
    min_left: float = 0.5


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window which is found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    kinds = len(number)
    windows = (ids[:-2] * kinds + ids[1:-1]) * kinds + ids[2:] if kinds < 1 << 20 else None
    if windows is None:  # the product would not fit
        pairs = np.unique(ids[:-2] * kinds + ids[1:-1], return_inverse=True)[1]
        windows = pairs * kinds + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    again = np.zeros(n - 2, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def normalised(line_words: list[str]) -> str:
    return _DIGITS.sub("0", " ".join(line_words).lower())


def measure(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line hashes, words of each of these lines)."""
    text = text or ""
    words: list[str] = []
    dups, seen, lines = 0, set(), {}
    for line in text.split("\n"):
        found = _WORDS.findall(line)
        if found:
            words += found
            if line in seen:
                dups += 1
            seen.add(line)
            h = xxhash.xxh3_64_intdigest(normalised(found).encode("utf-8", "surrogatepass")) - (1 << 63)
            lines[h] = lines.get(h, 0) + len(found)
    return len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), dups, repeated_words(words), list(lines), list(lines.values())


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, n_removed_words and kept."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for at in range(0, len(texts), 1000):
                cols = list(zip(*map(measure, texts[at : at + 1000])))
                counts = [pa.array(c, pa.int64()) for c in cols[:5]]
                lines = [pa.array(c, pa.list_(pa.int64())) for c in cols[5:]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at : at + 1000], batch.column(1)[at : at + 1000], batch.column(3)[at : at + 1000], *counts, *lines],
                    names=["doc_id", "host", "content", *_COUNTS, "hashes", "sizes"],
                )

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long"), F.col(host_col).cast("string"), text, F.xxhash64(text))
    schema = "doc_id long, host string, content long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", hashes array<long>, sizes array<long>"
    measured = rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    measured = written(measured, "lines")

    hosts = measured.groupBy("host").agg(F.countDistinct("content").alias("texts"))
    lines = measured.select("host", "content", F.explode("hashes").alias("hash"))
    counted = lines.groupBy("host", "hash").agg(F.countDistinct("content").alias("in_texts")).where(F.col("in_texts") >= rules.least)
    common = counted.join(hosts, counted["host"].eqNullSafe(hosts["host"])).where(F.col("in_texts") > rules.share * F.col("texts"))
    common = common.select(counted["host"].alias("common_host"), F.col("hash").alias("common_hash"))

    base_failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") > rules.max_repeated * F.col("n_words"))
    own = measured.select("row", "host", F.explode(F.arrays_zip("hashes", "sizes")).alias("line"))
    own = own.select("row", "host", F.col("line.hashes").alias("hash"), F.col("line.sizes").alias("size"))
    removed = own.join(common, (F.col("hash") == F.col("common_hash")) & F.col("host").eqNullSafe(F.col("common_host")))
    removed = removed.groupBy("row").agg(F.sum("size").alias("n_removed_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < rules.min_words) | (left < rules.min_left * F.col("n_words"))
    out = measured.drop("hashes", "sizes").join(removed, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    return out.select("doc_id", *_COUNTS, base_failed.alias("base_failed"), "n_removed_words", (~base_failed & ~depleted).alias("kept"))


#: The same in DuckDB, on the table ``documents``.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT rid, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs
),
lined AS (
  SELECT rid, source, text, line, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM parts
),
lines AS (SELECT * FROM lined WHERE len(words) > 0),
dups AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, sum(len(words)) AS n_words,
         sum(list_sum(list_transform(words, lambda w: length(w)))) AS word_chars
  FROM lines GROUP BY rid
),
spots AS (
  SELECT rid, word, row_number() OVER (PARTITION BY rid ORDER BY pos, k) AS i
  FROM (SELECT rid, pos, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM lines)
),
windows AS (
  SELECT rid, i, word AS a, lead(word) OVER w AS b, lead(word, 2) OVER w AS c FROM spots WINDOW w AS (PARTITION BY rid ORDER BY i)
),
again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM windows WHERE c IS NOT NULL) WHERE n > 1
),
covered AS (
  SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY rid
),
normal AS (
  SELECT rid, source, text, len(words) AS size, regexp_replace(lower(list_aggregate(words, 'string_agg', ' ')), '[0-9]', '0', 'g') AS line FROM lines
),
counted AS (SELECT source, line, count(DISTINCT text) AS in_texts FROM normal GROUP BY source, line),
hosts AS (SELECT source, count(DISTINCT text) AS texts FROM docs GROUP BY source),
common AS (
  SELECT c.source, c.line FROM counted c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
  WHERE c.in_texts >= 10 AND c.in_texts > CAST(0.02 AS DOUBLE) * h.texts
),
removed AS (
  SELECT n.rid, sum(n.size) AS n_removed_words FROM normal n JOIN common c ON n.line = c.line AND n.source IS NOT DISTINCT FROM c.source GROUP BY n.rid
),
measured AS (
  SELECT d.doc_id, coalesce(u.n_words, 0) AS n_words, coalesce(u.word_chars, 0) AS word_chars,
         len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS n_symbols, coalesce(u.n_dup_lines, 0) AS n_dup_lines,
         coalesce(v.n_repeat_words, 0) AS n_repeat_words, coalesce(r.n_removed_words, 0) AS n_removed_words
  FROM docs d LEFT JOIN dups u USING (rid) LEFT JOIN covered v USING (rid) LEFT JOIN removed r USING (rid)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(n_removed_words AS BIGINT) AS n_removed_words,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND NOT (n_words - n_removed_words < 50 OR n_words - n_removed_words < CAST(0.5 AS DOUBLE) * n_words) AS kept
FROM measured
"""
