"""Language identification by rank-order n-gram profiles.

A language's profile is its ``size`` most frequent character n-grams (1 to 3 letters, words bounded by a space) in rank
order; a document has such a profile of its own. The out-of-place distance sums, over the document's n-grams, how far
each stands from its rank in the language's profile (``size`` if it is missing). The nearest language wins.

The profiles are fitted on all labelled rows: tasks sum counts, which Spark adds up, so that texts are not shuffled. A
caller may ask for about ``sample`` rows of each language instead, chosen by a hash of the id. Prediction is one pass
over the whole texts without a shuffle.

Defined results: null text and text without letters give ``und`` with score 0; ties of distance go to the first language
in alphabetical order and ties of count to the smaller code; without any labelled row every text is ``und``; repeated
rows are predicted each on their own; a text of any length is counted as a whole; an empty table gives an empty result;
other columns are not read.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.llm.storage import small_batches
from skylattice.llm.worker import released
from skylattice.operators.quantiles import exact_quantiles

UNKNOWN = "und"
#: Characters, and texts, that are counted at a time (bounds a task's memory).
BLOCK_CHARS, BLOCK_TEXTS = 1 << 18, 1 << 10
#: Counts of n-grams that a task holds before it hands them on.
HELD = 1 << 20
#: Stands for the space before a bigram's letter, where 0 would make it a single letter.
MARK = (1 << 21) - 1


@dataclass(frozen=True)
class Profiles:
    langs: tuple[str, ...]
    grams: tuple[tuple[int, ...], ...]  # of each language, most frequent first
    size: int


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([not 0xD800 <= at <= 0xDFFF and chr(at).isalpha() for at in range(0x110000)])


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, code and count of the distinct n-grams of each text; any letter of any script counts as itself.

    A code holds three code points in 21 bits each: of a trigram its own, with 0 for a space; of a bigram the first, 0
    and the second, with MARK for a space in front; of a single letter 0, 0 and its own. Within a block, letters are
    numbered, so that text number and n-gram sort as one integer.
    """
    parts = [t.lower() + "\n" for t in texts]
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    owner = np.repeat(np.arange(len(parts), dtype=np.uint64), [len(p) for p in parts])
    present = np.zeros(0x110000, dtype=bool)
    present[points] = True
    alphabet = np.concatenate([[0], np.flatnonzero(present & _letters()), [MARK]]).astype(np.uint64)
    number = np.zeros(0x110000, dtype=np.uint64)
    number[alphabet[1:-1]] = np.arange(1, len(alphabet) - 1)
    bits, mark = np.uint64(int(len(alphabet)).bit_length()), np.uint64(len(alphabet) - 1)
    c = number[points]
    keep = (c > 0) | np.concatenate([[True], c[:-1] > 0])  # one space between words
    c, owner = c[keep], owner[keep] << (bits * np.uint64(3))
    before, after = np.concatenate([[0], c[:-1]]).astype(np.uint64), np.concatenate([c[1:], [0]]).astype(np.uint64)
    letter, pair = c > 0, (c > 0) | (before > 0)
    two = np.where(before > 0, before, mark) << (bits * np.uint64(2)) | c
    three = before << (bits * np.uint64(2)) | c << bits | after
    grams = np.concatenate([(owner | c)[letter], (owner | two)[pair], (owner | three)[letter]])
    grams.sort()
    at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, dtype=np.int64)
    counts, grams = np.diff(np.append(at, len(grams))), grams[at]
    low = (np.uint64(1) << bits) - np.uint64(1)
    code = [alphabet[(grams >> (bits * np.uint64(k))) & low] for k in range(3)]
    return (grams >> (bits * np.uint64(3))).astype(np.int64), code[2] << np.uint64(42) | code[1] << np.uint64(21) | code[0], counts


def _ranked(owner: np.ndarray, codes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, code and rank of each text's ``size`` most frequent n-grams; ties by code."""
    order = np.lexsort((codes, -counts, owner))
    owner, codes = owner[order], codes[order]
    start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
    keep = rank < size
    return owner[keep], codes[keep], rank[keep]


def blocks(texts: list[str]):
    """Ranges of up to ``BLOCK_TEXTS`` texts with about ``BLOCK_CHARS`` characters each."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > BLOCK_CHARS or i - start >= BLOCK_TEXTS:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def predict(texts: list[str | None], profiles: Profiles) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and distance of each text. The score is the lead over the second language, as a share of its
    distance; the distance is the mean of the text's n-grams, as a share of the largest one."""
    langs, scores, distance = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts))
    if not profiles.langs:
        return langs, scores, distance
    known = np.unique(np.array([g for gs in profiles.grams for g in gs], dtype=np.uint64))
    ranks = np.full((len(known) + 1, len(profiles.langs)), -1, dtype=np.int64)
    for k, gs in enumerate(profiles.grams):
        ranks[np.searchsorted(known, np.array(gs, dtype=np.uint64)), k] = np.arange(len(gs))
    whole = [t or "" for t in texts]
    for lo, hi in blocks(whole):
        owner, codes, rank = _ranked(*_counted(whole[lo:hi]), profiles.size)
        if not len(owner):
            continue
        at = np.searchsorted(known, codes)
        at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != codes)] = len(known)
        held = ranks[at]
        out = np.where(held < 0, profiles.size, np.abs(held - rank[:, None]))
        total = np.stack([np.bincount(owner, weights=out[:, k], minlength=hi - lo) for k in range(out.shape[1])], axis=1)
        some = np.bincount(owner, minlength=hi - lo)
        best = np.argmin(total, axis=1)
        least, most = total[np.arange(hi - lo), best], some * float(profiles.size)
        second = np.partition(total, 1, axis=1)[:, 1] if total.shape[1] > 1 else most
        lead = np.clip((second - least) / np.maximum(second, 1), 0, 1)
        for i in np.flatnonzero(some):
            langs[lo + i], scores[lo + i], distance[lo + i] = profiles.langs[best[i]], lead[i], least[i] / most[i]
    return langs, scores, distance


def _labelled(rows: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int | None) -> DataFrame:
    """(lang, text) of the labelled rows: all of them, or about ``sample`` of each language. For the latter a row per
    language is broadcast, far less than the profiles that a prediction needs, so the texts are not shuffled."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    if sample is not None:
        share = rows.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("share"))
        rows = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30) < F.col("share"))
    return rows.select("lang", "text")


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts, each code once."""
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(codes)).astype(np.int64)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language, summed over a task as far as ``HELD`` of them go."""
    held: dict[str, list] = {}
    size = 0

    def handed() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            codes, n = _added(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    for b in batches:
        texts: dict[str, list[str]] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            for lo, hi in blocks(own):  # of one language, so as one text
                _, codes, counts = _counted(["\n".join(own[lo:hi])])
                held.setdefault(lang, []).append((codes, counts))
                size += len(codes)
        if size > HELD:
            held = {lang: [_added(parts)] for lang, parts in held.items()}
            size = sum(len(parts[0][0]) for parts in held.values())
            if size > HELD // 2:
                yield from handed()
                held, size = {}, 0
    yield from handed()


def fit(rows: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int | None = None, size: int = 400) -> Profiles:
    """Profiles of all languages in ``rows``, ``size`` numbers for each. Rows without a text, id or language are not used."""
    small_batches(rows.sparkSession)
    chosen = _labelled(rows, id_col, text_col, lang_col, sample)
    counted = chosen.mapInArrow(lambda batches: released(_grams(batches)), "lang string, gram long, n long")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = summed.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect()
    found: dict[str, list[int]] = {}
    for r in best:
        found.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(tuple(found), tuple(map(tuple, found.values())), size)


def reach(
    rows: DataFrame, profiles: Profiles, id_col: str, text_col: str, lang_col: str, sample: int | None = None, share: float = 0.999, margin: float = 1.3
) -> dict[str, float]:
    """How far a text in each language may be from its profile: ``margin`` times the distance within which ``share`` of
    the labelled rows of that language lie."""
    chosen = _labelled(rows, id_col, text_col, lang_col, sample)
    return reach_of(chosen.select("lang", predicted(F.col("text"), profiles, rows.sparkSession).alias("found")), share, margin)


def reach_of(found: DataFrame, share: float = 0.999, margin: float = 1.3) -> dict[str, float]:
    """The same from ``found`` (lang, found: what ``predicted`` gave) of the labelled rows; an exact quantile."""
    own = found.where("found.lang_pred = lang").select("lang", F.col("found.distance").alias("distance"))
    return {r["lang"]: min(1.0, margin * r["far"]) for r in exact_quantiles(own, ["lang"], "distance", {"far": share}).collect()}


def predicted(text: Column, profiles: Profiles, spark) -> Column:
    """Struct (lang_pred, score, distance) of a text column."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(profiles)  # ``size`` numbers for each language

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [predict(texts.slice(at, BLOCK_TEXTS).to_pylist(), held.value) for at in range(0, max(len(texts), 1), BLOCK_TEXTS)]
            langs = pa.array([x for p in parts for x in p[0]], pa.string())
            yield pa.StructArray.from_arrays([langs, *[pa.array(np.concatenate([p[k] for p in parts])) for k in (1, 2)]], names=["lang_pred", "score", "distance"])

    @F.arrow_udf("lang_pred string, score double, distance double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from released(found(batches))

    return of(text)
