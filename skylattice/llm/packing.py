"""Vector bin packing of examples into training sequences.

Every task packs the rows it reads, window by window, with the bin-centric dot-product heuristic: a sequence is opened
and takes, again and again, the example with the largest dot product of its needs and the room left (tokens, segments,
loss-bearing tokens), while one fits. Needs and room are shares of the limits. Where cutting is allowed, an example is
cut to close a sequence at a limit. No rows move between tasks, so nothing is shuffled and skew does not matter; a task
that runs again reads the same rows and makes the same sequences.

Defined results: null text packs as an empty one (its end id alone); rows with a repeated or null id are packed each on
their own; a text of any length is cut into as many sequences as it needs; of examples with equal products the first one
in the task's order is taken; an empty table gives no pieces; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.storage import small_batches
from skylattice.llm.token_memo import SLICE, encoder
from skylattice.llm.worker import released

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    """Of one sequence. ``window`` examples are weighed against each other at a time (bounds a task's memory)."""

    tokens: int = 2048
    segments: int = 128
    loss_tokens: int = 2048
    window: int = 512


def powers(n: int) -> list[int]:
    """``n`` as falling powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack(tokens: np.ndarray, loss: np.ndarray, limits: Limits, cut: bool, last: bool) -> tuple[list, list]:
    """Packs examples ``0..n-1`` into sequences ``[(example, start, length), ...]``.

    Returns the closed sequences and the pieces that wait for the next window (none if ``last``). Without ``cut``, an
    example stays whole; one beyond the limits gets a sequence of its own.
    """
    room = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.float64)
    closed: list[list[tuple[int, int, int]]] = []
    start = np.zeros(len(tokens), dtype=np.int64)
    left, bearing = tokens.astype(np.int64).copy(), loss.astype(np.int64).copy()
    if cut:
        size = min(limits.tokens, limits.loss_tokens)
        for i in np.flatnonzero(left >= size):
            while left[i] >= size:
                closed.append([(int(i), int(start[i]), size)])
                start[i] += size
                left[i] -= size
            bearing[i] = min(bearing[i], left[i])
    else:
        for i in np.flatnonzero((left > limits.tokens) | (bearing > limits.loss_tokens)):
            closed.append([(int(i), 0, int(left[i]))])
            left[i] = 0
    live = np.flatnonzero(left > 0)
    while live.size:
        free, bin_ = room.copy(), []
        needs = np.stack([left[live], np.ones(live.size), bearing[live]], axis=1)
        shares, open_ = needs / room, np.ones(live.size, dtype=bool)
        while True:
            fits = open_ & (needs <= free).all(axis=1)
            if not fits.any():
                break
            k = int(np.argmax(np.where(fits, shares @ (free / room), -1.0)))
            bin_.append((int(live[k]), int(start[live[k]]), int(left[live[k]])))
            free -= needs[k]
            open_[k] = False
            if free[1] < 1 or free[0] < 1:
                break
        if cut and free[1] >= 1 and open_.any() and min(free[0], free[2]) >= 1:  # none fits whole: cut the largest
            k = int(np.argmax(np.where(open_, needs[:, 0], -1)))
            n = int(min(free[0], free[2], needs[k, 0]))
            i = live[k]
            bin_.append((int(i), int(start[i]), n))
            start[i] += n
            left[i] -= n
            bearing[i] = min(bearing[i], left[i])
            free[0] -= n
        if cut and free[0] > 0:
            if not last and free[1] >= 1 and not open_.any():  # more examples may still fill it
                return closed, bin_
            closed += shortened(bin_, int(limits.tokens - free[0]))
        else:
            closed.append(bin_)
        live = live[open_ & (left[live] > 0)]
    return closed, []


def shortened(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """A sequence that stays short, cut into sequences of a power of two tokens each: those need no padding."""
    out, queue = [], list(pieces)
    for size in powers(total):
        bin_ = []
        while size:
            i, s, n = queue.pop(0)
            bin_.append((i, s, min(n, size)))
            if n > size:
                queue.insert(0, (i, s + size, n - size))
            size -= min(n, size)
        out.append(bin_)
    return out


def pack_documents(
    docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of all documents of ``docs``, cut freely; every token bears loss. See ``PIECES`` for the columns."""

    def run(batches):
        enc, task, count = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray, int]] = []  # id, all ids of the document, first one that is not packed yet

        def emit(last: bool):
            """Packs what is held."""
            nonlocal held, count
            left = np.array([len(ids) - s for _, ids, s in held], dtype=np.int64)
            closed, open_ = pack(left, left, limits, True, last)
            rows = []
            for bin_ in closed:
                offset = 0
                for i, s, n in bin_:
                    doc, ids, first = held[i]
                    s += first
                    rows.append((doc, s, n, zlib.crc32(ids[s : s + n]), len(ids), (task << 33) + count, offset))
                    offset += n
                count += 1
            held = [(held[i][0], held[i][1], held[i][2] + s) for i, s, _ in open_]
            cols = list(zip(*rows)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in PIECES.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                doc_ids = batch.column(0).slice(at, SLICE).to_pylist()
                texts = [ids.astype("<u4") for ids in enc.documents(batch.column(1).slice(at, SLICE), end_id)]
                for k in range(0, len(texts), limits.window):
                    held += [(d, ids, 0) for d, ids in zip(doc_ids[k : k + limits.window], texts[k : k + limits.window])]
                    yield emit(False)
        yield emit(True)

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(lambda batches: released(run(batches)), PIECES)


def count_turns(turns: DataFrame, tokenizer_path: str, id_col: str = "conv_id", role_col: str = "role", text_col: str = "text", answers: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Tokens of each conversation (example_id, tokens, loss_tokens): every turn's ids and one end id; only turns of the roles
    ``answers`` bear loss. Turns without an id belong to no conversation; null text is an empty turn, a null role bears none."""

    def run(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                n = np.array([len(ids) for ids in enc.documents(part.column(2), 1)], dtype=np.int64)
                bears = np.array([role in answers for role in part.column(1).to_pylist()], dtype=bool)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(np.where(bears, n, 0))], names=["example_id", "tokens", "loss_tokens"])

    small_batches(turns.sparkSession)
    rows = turns.select(F.col(id_col).cast("string"), F.col(role_col).cast("string"), F.col(text_col).cast("string")).where(F.col(id_col).isNotNull())
    counted = rows.mapInArrow(lambda batches: released(run(batches)), "example_id string, tokens long, loss_tokens long")
    return counted.groupBy("example_id").agg(F.sum("tokens").alias("tokens"), F.sum("loss_tokens").alias("loss_tokens"))


def pack_examples(
    examples: DataFrame, id_col: str, tokens_col: str, loss_col: str, limits: Limits = Limits()
) -> DataFrame:
    """Packs whole instruction examples (none is cut) given by their token and loss-token counts.

    Returns example_id, length, loss_tokens, sequence_id and offset per example. Null or negative counts are 0, and an
    example of no tokens takes no room and is left out. An example beyond a limit has a sequence of its own.
    """

    def run(batches):
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, n, loss = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for at in range(0, len(ids), limits.window):
                part = slice(at, at + limits.window)
                rows = []
                for bin_ in pack(n[part], np.minimum(loss[part], n[part]), limits, False, True)[0]:
                    offset = 0
                    for i, _, size in bin_:
                        rows.append((ids[at + i], size, int(loss[at + i]), (task << 33) + count, offset))
                        offset += size
                    count += 1
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(cols)],
                    names=["example_id", "length", "loss_tokens", "sequence_id", "offset"],
                )

    count = lambda c: F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0))
    return examples.select(F.col(id_col).cast("string"), count(tokens_col).alias("n"), count(loss_col).alias("loss")).mapInArrow(
        run, "example_id string, length long, loss_tokens long, sequence_id long, offset long"
    )
