"""Toxicity scores of texts restored from obfuscation by a noisy-channel decoder.

Spans that look disguised (letters mixed with stand-ins at any place, letters or stand-ins spaced out, letters joined by
symbols or repeated) become a lattice of the characters each position may stand for. A Viterbi search over the lattice, under a character trigram model and
a channel model, finds the likeliest restorations. The model's counts are gathered from all texts by Spark. Restored
texts are then scored by a lexicon of words and beginnings of words that mark labelled toxic rows, by
logistic regression.

Labels are learned from at most ``sample`` labelled rows (those with the lowest hash of the id), which is small enough
to broadcast. Scoring is one pass over the whole texts without a shuffle.

Defined results: null and empty texts score as a text without evidence; labels other than 0 and 1 and null ids are not
learned from, and an id with both labels is toxic; without labelled rows of both kinds every score is 1 or 0 as they are
(0 if there are none); repeated rows are scored each on their own; features of equal rank are taken in alphabetical
order; a text of any length is scored as a whole; an empty table gives an empty result; other columns are not read.
"""

import math
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.llm.storage import small_batches
from skylattice.llm.worker import released

#: Characters of the model, and what a disguising character may stand for.
LETTERS = " abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœšž"
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
    "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¢": "c",
}
JOINERS = ".-_*~'`^,:;/\\#%&=\""
SIZE = 64
OTHER = SIZE - 1
#: Log-probabilities of the channel: a letter as itself, another character in its place, one put in between, one that
#: could stand for a letter put in between, or a letter said again.
SAME, STAND_IN, PUT_IN, STRAY, AGAIN = math.log(0.9), math.log(0.3), math.log(0.1), math.log(0.002), math.log(0.05)

_CODE = {c: k for k, c in enumerate(LETTERS)}
_WORD = re.compile(r"[^\W\d_]+")
_STAND_IN = re.compile("[" + re.escape("".join(STANDS_FOR)) + "]")
#: Letters and stand-ins that stand alone, one after the other, and what any such run has in it.
_UNIT = f"(?:[^\\W\\d_]|{_STAND_IN.pattern})"
_SPACED = re.compile(rf"(?<![^\W_]){_UNIT}(?:[\s.\-_*]{{1,2}}{_UNIT}){{2,}}(?![^\W_])")
_TWO_ALONE = re.compile(rf"[\s.\-_*]{_UNIT}[\s.\-_*]{{1,2}}{_UNIT}(?![^\W_])")
#: Within a word: a joiner between letters, or a letter three times in a row.
_JOINED = re.compile(r"[^\W\d_][.\-_*~'`^,:;/\\#%&=\"]+[^\W\d_]|([^\W\d_])\1\1")
#: What is not a letter or digit, at either end.
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
#: Lengths of a word's beginning that count as features besides the word.
PREFIXES = (4, 5, 6)
#: Positions after which what all restorations begin with is put aside.
STEP = 64


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.int32)
    for at in range(0x110000):
        if not 0xD800 <= at <= 0xDFFF and chr(at).isalpha():
            table[at] = _CODE.get(chr(at), OTHER)
    return table


def trigram_counts(texts: list[str]) -> np.ndarray:
    """How often each character trigram (a*SIZE*SIZE + b*SIZE + c) occurs, words being bounded by a space."""
    total = np.zeros(SIZE**3, dtype=np.int64)
    for at in range(0, len(texts), 256):
        points = np.frombuffer((" " + " ".join(texts[at : at + 256]).lower() + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        c = _codes()[points]
        c = c[(c > 0) | np.concatenate([[True], c[:-1] > 0])]
        if len(c) > 2:
            total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
    return total


def language_model(texts: DataFrame, text_col: str) -> np.ndarray:
    """Log-probabilities of a character after two others, interpolated with shorter contexts, from all of ``texts``.

    A row per task and trigram is shuffled; at most SIZE**3 sums reach the driver, whatever the corpus holds.
    """

    def count(batches):
        total = np.zeros(SIZE**3, dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                total += trigram_counts([t for t in b.column(0).slice(at, 512).to_pylist() if t])
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": found, "n": total[found]})

    small_batches(texts.sparkSession)
    summed = texts.select(F.col(text_col).alias("text")).mapInArrow(lambda batches: released(count(batches)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    n = np.zeros(SIZE**3)
    for gram, k in summed.collect():
        n[gram] = k
    return log_probabilities(n.reshape(SIZE, SIZE, SIZE))


def log_probabilities(n: np.ndarray) -> np.ndarray:
    """Witten-Bell interpolation of trigram, bigram and unigram shares."""
    share = (n.sum((0, 1)) + 1) / (n.sum() + SIZE)
    for counts in (n.sum(0), n):
        total, kinds = counts.sum(-1, keepdims=True), (counts > 0).sum(-1, keepdims=True)
        share = (counts + np.maximum(kinds, 1) * share) / (total + np.maximum(kinds, 1))
    return np.log(share)


def lattice(span: str) -> list[list[tuple[int, float]]]:
    """For each position the characters it may stand for (-1: none) with the channel's log-probability."""
    out: list[list[tuple[int, float]]] = []
    last = ""
    for c in span:
        if c.isalpha():
            found = [(_CODE.get(c, OTHER), SAME)]
            if c == last:
                found.append((-1, AGAIN))
        else:
            found = [(_CODE[x], STAND_IN) for x in STANDS_FOR.get(c, "")]
            found.append((-1, STRAY if found else PUT_IN))
            if c.isspace():
                found.append((0, PUT_IN))
            elif c not in STANDS_FOR and c not in JOINERS:
                found.append((0, PUT_IN))
        out.append(found)
        if c.isalpha():
            last = c
    return out


def disguised(token: str) -> bool:
    """Whether a token mixes letters with stand-ins at any place, joins letters by other characters or repeats them."""
    return bool(_STAND_IN.search(token) and _WORD.search(token) or _JOINED.search(token))


def decode(span: str, model: np.ndarray, best: int = 3) -> list[str]:
    """The ``best`` likeliest restorations of a lower-case span of any length: a Viterbi search whose states are the last two
    characters, all of which are kept. Restorations soon agree on how a long span begins, so that memory stays small."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    begun: list[str] = []
    for k, found in enumerate(lattice(span), 1):
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (p, text) in states.items():
            for c, channel in found:
                if c < 0:
                    key, q, t = (a, b), p + channel, text
                elif c == 0 and b == 0:
                    key, q, t = (a, b), p + channel, text
                else:
                    key, q, t = (b, c), p + channel + model[a, b, c], text + (LETTERS[c] if c < len(LETTERS) else "�")
                if key not in new or q > new[key][0]:
                    new[key] = (q, t)
        states = new
        if not k % STEP:
            same = os.path.commonprefix([t for _, t in states.values()])
            begun.append(same)
            states = {key: (p, t[len(same) :]) for key, (p, t) in states.items()}
    ended = [(p + (model[a, b, 0] if b else 0.0), t) for (a, b), (p, t) in states.items()]
    return ["".join([*begun, t]).strip() for _, t in sorted(ended, reverse=True)[:best]]


def features(words: set[str]) -> set[str]:
    """The words and their beginnings (``^`` and PREFIXES letters), which compounds of one stem share."""
    return words | {"^" + w[:k] for w in words for k in PREFIXES if len(w) > k}


class Restorer:
    """Tokens of texts and what they restore to. Each distinct token is looked at once: ``memo`` keeps what ``of`` makes
    of its features, up to ``limit`` tokens; when it is full the later half goes, since frequent tokens come first."""

    def __init__(self, model: np.ndarray, of=frozenset, limit: int = 200_000):
        self.model, self.of, self.limit, self.memo = model, of, limit, {}

    def tokens(self, text: str) -> list:
        """``of`` each distinct token and each run of spaced letters."""
        low = text.lower()
        tokens = set(low.split())
        memo = self.memo
        found = [memo[t] if t in memo else self._keep(t) for t in tokens]
        if _TWO_ALONE.search(low):
            spans = {m[0] for m in _SPACED.finditer(low)}
            spans |= {_EDGES.sub("", s) for s in spans}
            found += [self.of(features(self._restored(s))) for s in spans if _WORD.search(s)]
        return found

    def _keep(self, token: str):
        got = set(_WORD.findall(token))
        if disguised(token):
            got |= self._restored(token)
            core = _EDGES.sub("", token)  # without punctuation that could be read as letters
            if core != token and disguised(core):
                got |= self._restored(core)
        if len(self.memo) >= self.limit:
            for old in list(self.memo)[self.limit // 2 :]:
                del self.memo[old]
        kept = self.memo[token] = self.of(features(got))
        return kept

    def _restored(self, span: str) -> set[str]:
        return {w for text in decode(span, self.model) for w in _WORD.findall(text)}


@dataclass(frozen=True)
class Scorer:
    """What a prediction needs: the character model, the lexicon's features with their weights, and the offset."""

    model: np.ndarray
    weights: dict[str, float]
    offset: float

    def restorer(self) -> Restorer:
        return Restorer(self.model, lambda found: tuple(found & self.weights.keys()))

    def evidence(self, restorer: Restorer, text: str | None) -> float:
        """Sum of the weights of the text's distinct features."""
        found = {w for token in restorer.tokens(text) if token for w in token} if text else ()
        return self.offset + sum(self.weights[w] for w in found)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence, -30, 30)))


def bound(base: float) -> float:
    """Share of toxic rows that marks a feature: twice the base rate, or half way to one where that is less."""
    return min(2 * base, (1 + base) / 2)


def lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int, z: float = 3.0) -> list[str]:
    """The features that mark toxic rows, the surest first: the lower bound (Wilson, ``z`` standard errors) of their
    share of toxic rows is above ``bound``."""
    base, out = toxic / (toxic + clean), {}
    for word, t, c in counts:
        n, share = t + c, t / (t + c)
        spread = z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
        low = (share + z * z / (2 * n) - spread) / (1 + z * z / n)
        if low > bound(base):
            out[word] = low
    return sorted(out, key=lambda w: (-out[w], w))


def logistic(rows: list[list[int]], y: np.ndarray, size: int, penalty: float = 2e-5, rounds: int = 200) -> np.ndarray:
    """Weights of ``size`` binary features (listed by row) and, last, the offset: penalized logistic regression by
    gradient steps scaled for each weight (Adam), whose step length falls to zero."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.fromiter((k for r in rows for k in r), dtype=np.int64, count=len(at))
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for step in range(1, rounds + 1):
        z = np.bincount(at, weights=w[cols], minlength=len(rows)) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append(np.bincount(cols, weights=error[at], minlength=size), error.sum()) / len(rows)
        g[:-1] += penalty * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000
) -> Scorer:
    """Character model from all ``docs``; lexicon and weights from the sampled ``labels`` (id, label)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = language_model(docs, "text")
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    chosen = marked.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.join(F.broadcast(chosen), "id").where("text is not null").select("text", "y")  # ``sample`` rows at most
    held = spark.sparkContext.broadcast(model)

    def count(batches):
        from collections import Counter

        restorer, found = Restorer(held.value, limit=50_000), {0: Counter(), 1: Counter()}
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found[y].update(set().union(*restorer.tokens(text)))
                found[y][""] += 1  # rows
        words = list(found[0].keys() | found[1].keys())
        t, c = ([found[y][w] for w in words] for y in (1, 0))
        yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "t": pa.array(t, pa.int64()), "c": pa.array(c, pa.int64())})

    counted = rows.mapInArrow(lambda batches: released(count(batches)), "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    whole = counted.where("word = ''").collect()
    toxic, clean = (whole[0]["t"], whole[0]["c"]) if whole else (0, 0)
    if not toxic or not clean:
        return Scorer(model, {}, 30.0 if toxic else -30.0)
    # features of three toxic rows or more of the sample, that are in few clean ones
    likely = counted.where(f"word <> '' and t >= 3 and t / (t + c) > {bound(toxic / (toxic + clean))}")
    known = lexicon([tuple(r) for r in likely.collect()], toxic, clean)
    number = spark.sparkContext.broadcast({w: k for k, w in enumerate(known)})

    def find(batches):
        restorer = Restorer(held.value, lambda found: tuple([number.value[w] for w in found & number.value.keys()]))
        for b in batches:
            found = [sorted({k for token in restorer.tokens(t) for k in token}) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["y", "found"])

    points = rows.mapInArrow(lambda batches: released(find(batches)), "y int, found array<int>").collect()  # ``sample`` rows at most
    w = logistic([r["found"] for r in points], np.array([r["y"] for r in points], dtype=np.float64), len(known))
    return Scorer(model, dict(zip(known, w[:-1].tolist())), float(w[-1]))


def scored(text: Column, scorer: Scorer, spark) -> Column:
    """Score (0 to 1) of a text column."""
    small_batches(spark)
    held = spark.sparkContext.broadcast(scorer)  # at most SIZE**3 numbers and the lexicon

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        restorer = held.value.restorer()
        for texts in batches:
            x = [held.value.evidence(restorer, t) for at in range(0, len(texts), 512) for t in texts.slice(at, 512).to_pylist()]
            yield pa.array(held.value.probability(np.array(x, dtype=np.float64)), pa.float64())

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from released(scores(batches))

    return of(text)
