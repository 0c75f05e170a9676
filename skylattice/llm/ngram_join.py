"""Similarity self-join of texts on the Jaccard similarity of their word n-gram sets, by MinHash banding.

1. One pass turns each text into its set of n-gram hashes, and that into a signature of ``bands`` band hashes; band and
   row counts are the cheapest that find a pair at the threshold with the wanted recall. Texts with equal n-gram sets
   form a class; the join runs between classes.
2. Band hashes are shuffled; each bucket links its classes to its smallest one, and the components of these links are
   candidate groups: every pair that shares a band lies within one group.
3. Within a group all pairs whose set sizes allow the threshold are verified on the full n-gram sets. A class weighs 1
   and more with its set's size. A group heavier than ``block`` is ordered by set size and cut into blocks, and each pair
   of blocks is a task of its own, so no task holds more than two blocks, however long the texts are. Similar pairs are
   counted where they are found; only a row per class and block pair leaves it, with an edge to the smallest class that
   it is connected to there. Only texts of candidate groups are dealt; others are told by a bitmap and stay in place.
4. Connected components of these edges are the classes' groups of near copies.

Defined results: words are what white space separates, in lower case; a text of fewer than ``n`` words is one n-gram;
texts without words (null, empty) link with nothing and are groups of their own; rows with one id and different texts
are told apart, and rows alike in both count as copies; a null id joins by its text like any other, and a group's id is
its smallest id that is not null; a similarity of exactly the threshold links; a text of any length is compared as a
whole; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.components import connected_components, with_groups
from skylattice.llm.storage import mixed, small_batches, written
from skylattice.llm.worker import held, released


@dataclass(frozen=True)
class Join:
    n: int = 5
    threshold: float = 0.8
    recall: float = 0.9999
    rows: int = 6
    block: int = 512  # weight of the classes of one block
    grams: int = 2000  # n-grams that weigh as much as a class
    seed: int = 1

    @property
    def bands(self) -> int:
        """Fewest bands that find a pair at the threshold with probability ``recall``."""
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold**self.rows))


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to ``limit`` words (frequent words come first and stay)."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < self.limit:
            self[word] = h
        return h


def _words() -> WordHashes:
    return held(("words",), WordHashes)


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the text's word n-grams."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_words().__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(n, len(h))
    total = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    return np.unique(mixed(total))


def set_hash(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


@lru_cache(maxsize=4)
def _permutations(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = mixed(np.arange(2 * count, dtype=np.uint64) + np.uint64(seed << 32))
    return random[:count].astype(np.uint32), random[count:].astype(np.uint32) | np.uint32(1)


def signatures(sets: list[np.ndarray], bands: int, rows: int, seed: int) -> np.ndarray:
    """Band hashes (one row per set) of non-empty n-gram sets."""
    values = np.concatenate(sets)
    values = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    shift, factor = _permutations(bands * rows, seed)
    out = np.zeros((bands, len(sets)), dtype=np.uint64)
    for b in range(bands):
        for r in range(rows):
            k = b * rows + r
            least = np.minimum.reduceat((values ^ shift[k]) * factor[k], start)
            out[b] = mixed(out[b] + least + np.uint64(b + 1))
    return out.T


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs (i of ``left``, j of ``right``; i < j where both hold the same) whose similarity is at least ``threshold``."""
    size = np.array([len(s) for s in sets], dtype=np.float64)
    same = left is right
    if len(left) * len(right) <= 64:
        out = []
        for i in left:
            for j in right:
                if (not same or i < j) and min(size[i], size[j]) >= threshold * max(size[i], size[j]) - 1e-9:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both >= threshold * (size[i] + size[j] - both) - 1e-9:
                        out.append((int(i), int(j)))
        return out
    used = left if same else np.concatenate([left, right])
    values, owner = np.concatenate([sets[i] for i in used]), np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1  # n-grams of a single set are in no intersection
    number = np.cumsum(count > 1) - 1
    column, owner = number[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    wide, n_left = int((count > 1).sum()), len(left)
    both = np.zeros((n_left, len(used) if same else len(right)), dtype=np.float64)
    for at in range(0, wide, 2048):
        lo, hi = np.searchsorted(column, [at, at + 2048])
        held = np.zeros((len(used), min(2048, wide - at)), dtype=np.float32)
        held[owner[lo:hi], column[lo:hi] - at] = 1
        both += held[:n_left] @ (held if same else held[n_left:]).T
    a, b = size[left][:, None], size[right][None, :]
    found = both >= threshold * (a + b - both) - 1e-9
    if same:
        found = np.triu(found, 1)
    return [(int(left[i]), int(right[j])) for i, j in zip(*np.nonzero(found))]


def _set_rows(docs: DataFrame, how: Join) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                sets = [ngram_set(t, how.n) for t in batch.column(2).slice(at, 256).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                bands = dict(zip(full, signatures([sets[i] for i in full], how.bands, how.rows, how.seed).astype(np.int64))) if full else {}
                nodes = [set_hash(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[at : at + 256],
                        keys[at : at + 256],
                        pa.array(nodes, pa.int64()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([bands.get(i) for i in range(len(sets))], pa.list_(pa.int64())),
                    ],
                    names=["id", "key", "node", "n_grams", "bands"],
                )

    return docs.mapInArrow(lambda batches: released(run(batches)), "id long, key long, node long, n_grams int, bands array<long>")


def _verify(units: DataFrame, how: Join) -> DataFrame:
    """Counts similar pairs in each unit. Rows of a unit: (unit, grp, side, node, m, text)."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["grp", "side", "node", "m"]).to_pydict()
        sets = [ngram_set(t, how.n) for t in table.column("text").to_pylist()]
        order: dict[int, list[int]] = {}
        seen = set()
        for i, (g, node, side) in enumerate(zip(rows["grp"], rows["node"], rows["side"])):
            if (node, side) not in seen and set_hash(sets[i]) == node:  # a repeated row comes more than once
                seen.add((node, side))
                order.setdefault(g, []).append(i)
        links, root = {}, {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for members in order.values():
            sides = [np.array([i for i in members if rows["side"][i] == s]) for s in (0, 1)]
            left, right = (sides[0], sides[1]) if len(sides[1]) else (sides[0], sides[0])
            if not len(left) or not len(right):
                continue
            for i, j in similar(sets, left, right, how.threshold):
                a, b = rows["node"][i], rows["node"][j]
                links[a] = links.get(a, 0) + rows["m"][j]
                links[b] = links.get(b, 0) + rows["m"][i]
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        nodes = list(links)
        return pa.table(
            {"node": pa.array(nodes, pa.int64()), "links": pa.array([links[x] for x in nodes], pa.int64()), "other": pa.array([find(x) for x in nodes], pa.int64())}
        )

    return units.groupBy("unit").applyInArrow(run, "node long, links long, other long")


def _block_pairs(many: DataFrame, how: Join) -> DataFrame:
    """Units for groups heavier than ``block``: (rep, node, m, grp, side, unit).

    A class's place in the order of set sizes follows from the weights of each size, with classes of one size spread by
    hash, so no group is sorted in one task. Blocks whose sizes lie too far apart hold no similar pair.
    """
    from pyspark.sql import Window

    grown = many.groupBy("component", "n_grams").agg(F.sum("weight").alias("same"), F.count("*").alias("k"))
    before = F.sum("same").over(Window.partitionBy("component").orderBy("n_grams")) - F.col("same")
    grown = written(grown.withColumn("before", before), "ngram-sizes")
    spread = F.pmod(F.xxhash64("node", F.lit(how.seed)), F.lit(1 << 20)) / float(1 << 20)
    size = F.struct("component", "n_grams").alias("size")
    placed = with_groups(many.withColumn("size", size), grown.select(size, "same", "before", "k"), "size", grown.agg(F.sum("k")).first()[0] or 0)
    placed = placed.withColumn("at", F.floor((F.col("before") + spread * F.col("same")) / how.block)).select("rep", "node", "m", "component", "n_grams", "at")
    blocks = placed.groupBy("component", "at").agg(F.min("n_grams").alias("low"), F.max("n_grams").alias("high"))
    x, y = blocks.alias("x"), blocks.alias("y")
    near = (F.col("x.at") <= F.col("y.at")) & (F.col("x.high") >= F.col("y.low") * how.threshold - 1e-9)
    pairs = x.join(y, (F.col("x.component") == F.col("y.component")) & near).select("x.component", F.col("x.at").alias("a"), F.col("y.at").alias("b"))
    sides = pairs.select("component", "a", "b", F.explode(F.array_distinct(F.array(F.col("a"), F.col("b")))).alias("at"))
    sides = sides.withColumn("side", F.when(F.col("at") == F.col("a"), 0).otherwise(1)).withColumn("unit", F.concat_ws("|", "component", "a", "b"))
    return placed.join(sides, ["component", "at"]).select("rep", "node", "m", F.col("component").alias("grp"), "side", "unit")


def _possible(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``possible``: false only where ``key``, a 64-bit hash, is not among ``keys``. Hashes set bits of a map
    of 32 million, 4 MB at any number of keys, so rows that no key can meet need not be dealt to find that out. Of the
    others some are possible by chance: 5 % at 1.8 million keys, more beyond; a join with the keys decides."""
    part = F.shiftrightunsigned("key", 54).alias("part")  # 1,024 parts of 32,768 bits
    at = F.col("key").bitwiseAND(32767)
    bits = keys.select(part, at.alias("at")).repartition("part").groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    possible = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return rows.withColumn("part", part).join(F.broadcast(bits), "part", "left").withColumn("possible", possible).drop("part", "bits")


def near_copies(docs: DataFrame, how: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, key (hash of id and text), n_links (other documents that are similar to it, copies
    included), class_id (smallest id of the documents that it is connected to) and first (whether it is the one of its
    class that stays: the smallest id, null last, then the smallest key; repeated rows share this flag)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.select("id", F.xxhash64("id", "text").alias("key"), "text")
    sets = written(_set_rows(docs, how), "ngram-sets")
    # copies of one text meet here, with partial sums, before anything is shuffled by band
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    classes = sets.where("node is not null").groupBy("node").agg(
        F.count("*").alias("m"), F.min("key").alias("rep"), F.min(place).alias("place"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")
    )
    classes = written(classes, "ngram-classes")
    banded = classes.select("node", F.posexplode("bands").alias("band", "hash"))
    buckets = banded.groupBy("band", "hash").agg(F.min("node").alias("least"), F.count("*").alias("k")).where("k > 1")
    stars = banded.join(buckets, ["band", "hash"]).where("node <> least").select("node", "least")
    groups = connected_components(stars, "node", "least")
    weight = (F.lit(1) + F.col("n_grams") / how.grams).alias("weight")
    members = written(groups.join(classes.select("node", "m", "rep", "n_grams", weight), "node"), "ngram-members")
    sizes = written(members.groupBy("component").agg(F.count("*").alias("k"), F.sum("weight").alias("group_weight")), "ngram-sizes")
    count = sizes.agg(F.sum("k")).first()[0] or 0
    many = written(with_groups(members, sizes, "component", count), "ngram-groups")

    small = many.where(F.col("group_weight") <= how.block)
    tasks = max(1, math.ceil((small.agg(F.sum("weight")).first()[0] or 0) / 2048))
    unit = F.pmod(F.xxhash64("component"), F.lit(tasks)).cast("string")
    small = small.select("rep", "node", "m", F.col("component").alias("grp"), F.lit(0).alias("side"), unit.alias("unit"))
    wanted = small.unionByName(_block_pairs(many.where(F.col("group_weight") > how.block), how))
    texts = _possible(docs.select("key", "text"), many.select(F.col("rep").alias("key"))).where("possible")
    units = texts.join(wanted, F.col("key") == F.col("rep")).select("unit", "grp", "side", "node", "m", "text")
    found = written(_verify(units, how), "ngram-links")

    near = connected_components(found, "node", "other")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = classes.select("node", "m", "place").join(links, "node", "left").join(near, "node", "left")
    joined = written(joined.withColumn("component", F.coalesce("component", "node")), "ngram-joined")
    least = joined.groupBy("component").agg(F.min("place").alias("least"), F.count("*").alias("k"))
    joined = with_groups(joined, least, "component", joined.count())
    joined = joined.select("node", "least", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    alone = F.col("node").isNull()
    return sets.select("id", "key", "node").join(joined, "node", "left").select(
        "id",
        "key",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("least.id")).alias("class_id"),
        (alone | (F.col("key") == F.col("least.key"))).alias("first"),
    )


def one_of_each(docs: DataFrame, how: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, in its own columns. Row for row, a text without words stays."""
    found = near_copies(docs, how, id_col, text_col).groupBy("key").agg(F.count_if("first").alias("n"))
    found = written(found.where("n <> 1"), "ngram-apart")
    # the row is one column of its own here, so its columns may have any names
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    id_, text = F.col(f"row.`{id_col}`").cast("long"), F.col(f"row.`{text_col}`").cast("string")
    rows = _possible(rows.withColumn("key", F.xxhash64(id_, text)), found)
    sure, rest = rows.where(~F.col("possible")).select("row"), rows.where("possible").join(found, "key", "left")
    if found.where("n > 1").isEmpty():  # no row comes twice, so the texts need not be read once more
        return sure.unionByName(rest.where("n is null").select("row")).select("row.*")
    single = F.col("n").isNull() | ((F.col("n") > 1) & ~F.coalesce(text.rlike(r"\S"), F.lit(False)))
    again = rest.where((F.col("n") > 1) & ~single).groupBy("key").agg(F.first("row").alias("row"))
    return sure.unionByName(rest.where(single).select("row")).unionByName(again.select("row")).select("row.*")


#: The same in DuckDB, on the table ``documents`` with distinct ids, by counting the n-grams that any two texts share.
SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS gram FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE shared >= CAST(0.8 AS DOUBLE) * (x.n + y.n - shared) - 1e-9),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
class AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
degree AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a)
SELECT c.doc_id, c.class_id, coalesce(d.n, 0) AS n_links FROM class c LEFT JOIN degree d USING (doc_id)
"""
