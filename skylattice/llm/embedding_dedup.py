"""Near-duplicate vectors by graph search in shards.

Equal vectors of one label are merged first. The others of a label are dealt over shards of about ``shard`` vectors by a
hash; each shard is one navigable small-world graph, stored as a row of a table in the shared folder. Then the label's
vectors query every shard of their label: a task is sent a graph once and the label's vectors (or one ``part`` of them,
where there are many) stream past it. Beams widen for the queries whose beam is full of near vectors (beyond ``widest``,
such a query is compared with the whole shard as a matrix product, which is cheaper than a beam that holds a large
group), and all beams double until the audits pass: a hashed sample of the queries is compared with the whole shard, a
larger one until ``proof`` links have been seen there, and ``recall`` of all links seen so must have been found.
Every pair is verified by cosine in double precision. Pairs are folded as they are found, into a count of links for each
query and into groups of the shard's vectors, so no task holds the pairs of a group and a large group of near copies
makes no row per pair. A task sends on an edge for each query with links and one for each vector that was linked to.
Components of these edges are the result.

Querying every shard costs (vectors of a label)^2 / ``shard`` searches; ``shard`` is the parameter to raise with memory.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label,
link with nothing and are components of their own; vectors of different lengths never link; a cosine of exactly the
threshold links; rows with a repeated id are vectors of their own that share the id; a null id takes part and its
component is the smallest id that is not null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.components import connected_components, with_groups
from skylattice.llm.hnsw import Graph
from skylattice.llm.storage import mixed, small_batches, written


@dataclass(frozen=True)
class Search:
    threshold: float = 0.98
    shard: int = 16_384
    part: int = 1 << 17  # queries that stream past one copy of a graph
    beam: int = 32
    widest: int = 128  # beyond this beam, a query is compared with its whole shard
    audit: int = 64
    proof: int = 16
    recall: float = 0.999


FOUND = "node long, links long, other long"
#: Queries that are searched in step, and pairs that are verified at a time.
STEP, PAIRS = 256, 1 << 15


def scaled(x: np.ndarray) -> np.ndarray:
    """``x`` in double precision, each row by a power of two, so that squares of huge or tiny components stay finite."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return (x / norms(x)[:, None]).astype(np.float32)


class Shard:
    """A shard's graph and what the queries that streamed past it have linked."""

    def __init__(self, nodes: np.ndarray, weights: np.ndarray, raw: np.ndarray, graph: Graph, how: Search):
        self.nodes, self.weights, self.raw, self.graph, self.how = nodes, weights, raw, graph, how
        self.norms = norms(raw)
        self.beam = min(how.beam, len(nodes))
        self.group = np.arange(len(nodes))  # of each vector: groups of vectors that a query links are one
        self.linked = np.zeros(len(nodes), dtype=bool)
        self.true = self.seen = 0  # audited links, and those of them that were found

    def _exact(self, x: np.ndarray, size: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether each query links with each vector of the shard."""
        yes = x @ self.raw.T >= self.how.threshold * (size[:, None] * self.norms)
        at = np.flatnonzero(own >= 0)
        yes[at, own[at]] = False
        return yes

    def _join(self, vectors: np.ndarray) -> None:
        """The vectors that one query links with."""
        groups = self.group[vectors]
        least = groups.min()
        if (groups != least).any():
            other = np.unique(groups)
            self.group[np.isin(self.group, other)] = least
        self.linked[vectors] = True

    def _step(self, units, x, size, own, beam):
        """Links of up to STEP queries: (number of links by weight, first vector or -1, [(query, vectors), ...])."""
        how, n = self.how, len(self.nodes)
        loose = how.threshold - 1e-4  # single precision is compared with a margin
        todo, found = np.arange(len(x)), []
        while len(todo) and beam <= how.widest:
            ids, sims = self.graph.query(units[todo], beam, own[todo])
            near = (sims >= loose) & (ids >= 0)
            full = near[:, -1] & (beam < n)
            rows, cols = np.nonzero(near & ~full[:, None])
            q, v = todo[rows], ids[rows, cols]
            q, v = q[own[q] != v], v[own[q] != v]
            for at in range(0, len(q), PAIRS):
                a, b = q[at : at + PAIRS], v[at : at + PAIRS]
                yes = (x[a] * self.raw[b]).sum(1) >= how.threshold * (size[a] * self.norms[b])
                found.append((a[yes], b[yes]))
            todo, beam = todo[full], min(4 * beam, n)
        if found:
            q, v = (np.concatenate(c) for c in zip(*found))
            order = np.argsort(q, kind="stable")
            q, v = q[order], v[order]
            at = np.flatnonzero(np.diff(q, prepend=-1))
            found = [(int(q[i]), part) for i, part in zip(at, np.split(v, at[1:]))] if len(q) else []
        for at in range(0, len(todo), 32):
            some = todo[at : at + 32]
            found += [(int(k), np.flatnonzero(row)) for k, row in zip(some, self._exact(x[some], size[some], own[some])) if row.any()]
        return found

    def ask(self, ids: np.ndarray, m: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, links, a linked node) of the queries that link with a vector of the shard."""
        x = scaled(x)
        size, units = norms(x), unit(x)
        own = np.minimum(np.searchsorted(self.nodes, ids), len(self.nodes) - 1)
        own = np.where(self.nodes[own] == ids, own, -1)  # the query's own number in the shard
        wanted = self.how.audit if self.true >= self.how.proof else 4 * self.how.audit
        sample = np.argsort(mixed(ids.astype(np.uint64) + np.uint64(7 << 40)), kind="stable")[:wanted]
        place = np.full(len(ids), -1)
        place[sample] = np.arange(len(sample))
        while True:
            links, first = np.zeros(len(ids), dtype=np.int64), np.full(len(ids), -1)
            true = seen = 0
            for at in range(0, len(ids), STEP):
                part = slice(at, at + STEP)
                checked = np.flatnonzero(place[part] >= 0)
                truth = np.zeros((len(checked), len(self.nodes)), dtype=bool)
                for k in range(0, len(checked), 32):
                    rows = at + checked[k : k + 32]
                    truth[k : k + 32] = self._exact(x[rows], size[rows], own[rows])
                row = dict(zip(checked.tolist(), truth))
                true += int(truth.sum())
                for k, vectors in self._step(units[part], x[part], size[part], own[part], self.beam):
                    links[at + k], first[at + k] = self.weights[vectors].sum(), vectors[0]
                    self._join(vectors)
                    if k in row:
                        seen += int(row[k][vectors].sum())
            if self.beam >= len(self.nodes) or self.seen + seen >= self.how.recall * (self.true + true):
                break
            self.beam = min(2 * self.beam, len(self.nodes))
        self.true, self.seen = self.true + true, self.seen + seen
        yes = first >= 0
        return ids[yes], links[yes], self.nodes[first[yes]]

    def rest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for the shard's vectors that were linked to: each with one vector of its group."""
        at = np.flatnonzero(self.linked & (self.group != np.arange(len(self.nodes))))
        return self.nodes[at], np.zeros(len(at), dtype=np.int64), self.nodes[self.group[at]]


def _graphs(vectors: DataFrame) -> DataFrame:
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        raw = scaled(np.array(table.column("vector").to_pylist(), dtype=np.float64))
        nodes, m = table.column("node").to_numpy(), table.column("m").to_numpy()
        blob = pickle.dumps((nodes, m, raw, Graph.build(unit(raw))), protocol=5)
        return pa.table({"label": table.column("label")[:1], "dim": table.column("dim")[:1], "shard": table.column("shard")[:1], "graph": pa.array([blob], pa.binary())})

    return vectors.groupBy("label", "dim", "shard").applyInArrow(build, "label string, dim int, shard int, graph binary")


def _asked(how: Search):
    """Streams rows sorted by graph, each graph's own row first and the queries after it, into links."""

    def run(batches):
        shard = None
        batch_of = lambda *c: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=["node", "links", "other"])
        for batch in batches:
            blob, node, m, vector = (batch.column(k) for k in ("graph", "node", "m", "vector"))
            for query, rows in groupby(range(batch.num_rows), key=lambda k: not blob[k].is_valid):
                rows = list(rows)
                if query:
                    some = slice(rows[0], rows[-1] + 1)
                    x = vector[some].flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                    yield batch_of(*shard.ask(node[some].to_numpy(), m[some].to_numpy(), x))
                    continue
                for k in rows:
                    if shard is not None:
                        yield batch_of(*shard.rest())
                    shard = Shard(*pickle.loads(blob[k].as_py()), how)
        if shard is not None:
            yield batch_of(*shard.rest())

    return run


def near_duplicates(
    vectors: DataFrame, how: Search = Search(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, n_links, component_id and kept (the vector's id is its component's) for every row of ``vectors``."""
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("string").alias("label"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(F.col("label").isNotNull() & fine, F.lit(False)))
    # a vector's node is a hash of its label and components; equal ones meet with partial sums
    rows = rows.withColumn("node", F.when(F.col("fine"), F.xxhash64("label", "vector")))
    merged = rows.where("fine").groupBy("node", "label", "vector").agg(F.count("*").alias("m"), F.min("id").alias("least"))
    merged = merged.withColumn("dim", F.size("vector"))
    share = lambda n: F.ceil(F.count("*") / n).cast("int")
    counts = written(merged.groupBy("label", "dim").agg(share(how.shard).alias("shards"), share(how.part).alias("parts")), "vector-counts")
    graphs_n, tasks = counts.agg(F.sum("shards"), F.sum(F.col("shards") * F.col("parts"))).first()
    dealt = merged.join(counts, ["label", "dim"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("node", F.lit(1)), F.col("shards")).cast("int")).withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int"))
    dealt = written(dealt, "vectors")
    # more partitions than graphs: few bytes are much work here, and adaptive coalescing would pile them up
    partitions = lambda n: max(1, min(4 * (n or 0), 1 << 16))
    graphs = written(_graphs(dealt.repartition(partitions(graphs_n), "label", "dim", "shard")), "graphs")

    keys = ["label", "dim", "shard", "part"]
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asked = dealt.select("label", "dim", "part", "node", "m", "vector", every("shards").alias("shard"))
    held = graphs.join(counts, ["label", "dim"]).select("label", "dim", "shard", "graph", every("parts").alias("part"))
    both = held.unionByName(asked, allowMissingColumns=True).repartition(partitions(tasks), *keys)
    found = both.sortWithinPartitions(*keys, F.col("graph").isNull()).select("graph", "node", "m", "vector").mapInArrow(_asked(how), FOUND)
    found = written(found, "vector-links")
    near = connected_components(found, "node", "other")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = dealt.select("node", "m", "least").join(links, "node", "left").join(near, "node", "left")
    joined = written(joined.withColumn("component", F.coalesce("component", "node")), "vector-components")
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("k"))
    joined = with_groups(joined, smallest, "component", joined.count()).select("node", "component_id", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("id", "node").join(joined, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )


#: The same in DuckDB, on the table ``embeddings`` with distinct ids, by comparing all pairs and taking shortest ids along links.
SQL = """
WITH RECURSIVE fine AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= CAST(0.98 AS DOUBLE)
),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT c.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM component c LEFT JOIN degree d USING (vec_id)
"""
