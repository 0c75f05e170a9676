"""Secrets in texts, and credentials whose parts prove each other.

Three kinds of spans are reported wherever they occur (assigned values, access identifiers, hexadecimal runs of full
length). Weaker candidates, which prose is full of, are reported only when complementary parts co-occur: account names,
short identifiers, short secrets, passwords within addresses, and endpoints. Parts are intervals of code points in a scope
(a block of lines without an empty line in between), and two parts co-occur if the second begins within ``reach`` code
points after the end of the first, in the same scope. A weak identifier needs a secret, a weak secret an identifier, an
endpoint both. An identifier's credential is itself with its nearest secret and nearest endpoint.

Spans are found in one pass over the texts. Parts of documents that hold an identifier and a secret are then joined as
intervals: by document and cell of ``reach`` code points, an earlier part by where it ends, a later one by where it begins
and by the cell before that. A cell holds at most ``reach`` / 3 parts of a role, since those do not overlap, so neither a
document full of candidates nor a group of copies makes a hot key or all pairs of anything.

Defined results: null text is an empty one; documents of null, equal or clashing ids are scanned each on their own; of
parts of a role that overlap a reported one stays, else that of the earlier kind, else the earlier one; of partners at the
same distance the one that begins earlier is the nearest; a text of any length is scanned as a whole; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.storage import small_batches, written
from skylattice.llm.worker import released

#: In the order in which spans of the same start are listed; the first BASE of them need no partner.
KINDS = ("assign", "access", "hex", "short_assign", "inline", "short_hex", "short_access", "account", "endpoint")
BASE = 3
IDENTIFIER, SECRET, ENDPOINT = 0, 1, 2
ROLES = (SECRET, IDENTIFIER, SECRET, SECRET, SECRET, SECRET, IDENTIFIER, IDENTIFIER, ENDPOINT)
ASSIGN, ACCESS, HEX, SHORT_ASSIGN, INLINE, SHORT_HEX, SHORT_ACCESS, ACCOUNT, ADDRESS = range(len(KINDS))

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{8,}")
_ACCOUNT = re.compile(r"""(?<![A-Za-z])(?:user(?:_?name)?|login|account|client_?id|(?:access_?)?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}""", re.I | re.A)
_URL = re.compile(r"""(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,11}://(?:([^\s:@/"'<>]{1,64}):([^\s@/"'<>]{3,128})@)?([^\s"'<>@]{3,})""")
_HOST = re.compile(r"""(?<![A-Za-z])(?:host(?:_?name)?|endpoint|server|base_?url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._-]+\.[A-Za-z0-9._-]+(?::\d+)?""", re.I | re.A)
_GAP = re.compile(r"\n[\x20\t\r]*\n")
_ALNUM = re.compile("[A-Za-z0-9]")
_ASSIGN_WORDS, _ACCOUNT_WORDS, _HOST_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key"), ("user", "login", "account", "client", "key"), ("host", "endpoint", "server", "url")


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every span of every kind, kind by kind."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        for m in _ASSIGN.finditer(text):
            n = m.end(2) - m.start(2)
            if n >= 6:
                found.append((ASSIGN if n >= 12 else SHORT_ASSIGN, *m.span()))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            n = m.end() - m.start()
            if n >= 12:
                found.append((ACCESS if n >= 18 else SHORT_ACCESS, *m.span()))
    for m in _HEX.finditer(text):
        a, b = m.span()
        if b - a >= 16:
            found.append((HEX, a, b))
        elif not m[0].isdigit() and not m[0].isalpha() and not _ALNUM.match(text, b) and not (a and _ALNUM.match(text, a - 1)):
            found.append((SHORT_HEX, a, b))
    if "://" in text:
        for m in _URL.finditer(text):
            found.append((ADDRESS, m.start(3), m.end(3)))
            if m[1]:
                found += [(ACCOUNT, *m.span(1)), (INLINE, *m.span(2))]
    if not any(ROLES[kind] == SECRET for kind, _, _ in found):
        return found  # without a secret neither names nor hosts can be reported
    if any(w in low for w in _ACCOUNT_WORDS):
        found += [(ACCOUNT, *m.span()) for m in _ACCOUNT.finditer(text)]
    if any(w in low for w in _HOST_WORDS):
        found += [(ADDRESS, *m.span()) for m in _HOST.finditer(text)]
    return found


def parts(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of spans of a role that overlap one: a base one, else that of the earlier kind, else the one that begins earlier.
    All base spans come first in their kinds' order, so each role keeps a row of spans that do not overlap."""
    kept: list[tuple[int, int, int]] = []
    taken: dict[int, list[tuple[int, int]]] = {IDENTIFIER: [], SECRET: [], ENDPOINT: []}
    for kind, start, end in sorted(found):
        row = taken[ROLES[kind]]
        at = bisect_left(row, (end, -1))  # rows before it begin before the end
        if not at or row[at - 1][1] <= start:
            insort(row, (start, end))
            kept.append((kind, start, end))
    return kept


def scan(text: str | None) -> tuple:
    """(n_assign, n_access, n_hex, base digest, base spans, weak candidates, parts by kind, block, start and end); parts
    are listed only where an identifier and a secret are among them."""
    found = candidates(text or "")
    base = sorted((start, kind, end) for kind, start, end in found if kind < BASE)
    n = [sum(kind == k for _, kind, _ in base) for k in range(BASE)]
    digest = hashlib.sha256(",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in base).encode()).hexdigest()
    held = parts(found) if len(found) > 1 else []
    roles = {ROLES[kind] for kind, _, _ in held}
    if not {IDENTIFIER, SECRET} <= roles:
        held = []
    gaps = [m.start() for m in _GAP.finditer(text)] if held else []
    blocks = [bisect_left(gaps, start) for _, start, _ in held]
    return *n, digest, base, len(found) - len(base), held, blocks


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_PART = pa.struct([("kind", pa.int32()), ("role", pa.int32()), ("block", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:long,kind:int,end:long>>, n_weak long,"
    " parts array<struct<kind:int,role:int,block:long,start:long,end:long>>"
)


def _scanned(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            cut = batch.slice(at, 256)
            rows = [scan(t) for t in cut.column(1).to_pylist()]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(BASE)]
            columns.append(pa.array([r[3] for r in rows], pa.string()))
            columns.append(pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in r[4]] for r in rows], pa.list_(_SPAN)))
            columns.append(pa.array([r[5] for r in rows], pa.int64()))
            listed = [[{"kind": k, "role": ROLES[k], "block": b, "start": s, "end": e} for (k, s, e), b in zip(r[6], r[7])] for r in rows]
            columns.append(pa.array(listed, pa.list_(_PART)))
            yield pa.RecordBatch.from_arrays([cut.column(0), *columns], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "n_weak", "parts"])


def neighbours(found: DataFrame, reach: int) -> DataFrame:
    """Interval join: parts (row, kind, role, block, start, end) that have a part of another role within ``reach`` in their
    block, with the nearest of each role (gap, start, kind, end) in ``near_0``, ``near_1`` and ``near_2``."""
    part = F.struct("start", "kind", "end")
    first = found.select("row", "block", F.col("role").alias("role_a"), part.alias("a"), F.expr(f"end div {reach}").alias("cell"))
    later = found.select("row", "block", F.col("role").alias("role_b"), part.alias("b"), F.explode(F.array(F.expr(f"start div {reach}"), F.expr(f"start div {reach} - 1"))).alias("cell"))
    near = (F.col("role_a") != F.col("role_b")) & F.col("b.start").between(F.col("a.end"), F.col("a.end") + reach)
    pairs = first.join(later, ["row", "block", "cell"]).where(near).withColumn("gap", F.col("b.start") - F.col("a.end"))
    side = lambda own, other: F.struct(F.col(f"role_{own}").alias("role"), F.col(own).alias("own"), F.col(f"role_{other}").alias("other"), F.struct(F.col("gap"), f"{other}.start", f"{other}.kind", f"{other}.end").alias("to"))
    both = pairs.select("row", F.explode(F.array(side("a", "b"), side("b", "a"))).alias("x")).select("row", "x.*")
    return both.groupBy("row", "role", "own").agg(*[F.min(F.when(F.col("other") == k, F.col("to"))).alias(f"near_{k}") for k in range(3)])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 300) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, n_weak (weak candidates found), reported
    (array of start, kind, end) and credentials (array of identifier, secret and endpoint or null, each of the same form)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    scanned = rows.mapInArrow(lambda batches: released(_scanned(batches)), _SCHEMA).withColumn("row", F.monotonically_increasing_id())
    scanned = written(scanned, "secrets")
    near = neighbours(scanned.select("row", F.explode("parts").alias("p")).select("row", "p.*"), reach)
    proven = F.when(F.col("role") == IDENTIFIER, F.col("near_1").isNotNull()).when(F.col("role") == SECRET, F.col("near_0").isNotNull()).otherwise(F.col("near_0").isNotNull() & F.col("near_1").isNotNull())
    short = lambda c: F.when(F.col(c).isNotNull(), F.struct(f"{c}.start", f"{c}.kind", f"{c}.end"))
    credential = F.struct(F.col("own").alias("identifier"), short("near_1").alias("secret"), short("near_2").alias("endpoint"))
    linked = near.where(proven).groupBy("row").agg(
        F.collect_list(F.when(F.col("own.kind") >= BASE, F.col("own"))).alias("linked"),  # of one document
        F.sort_array(F.collect_list(F.when(F.col("role") == IDENTIFIER, credential))).alias("credentials"),
    )
    out = scanned.join(linked, "row", "left")
    reported = F.sort_array(F.concat("base", F.coalesce("linked", F.array().cast("array<struct<start:long,kind:int,end:long>>"))))
    empty = F.array().cast("array<struct<identifier:struct<start:long,kind:int,end:long>,secret:struct<start:long,kind:int,end:long>,endpoint:struct<start:long,kind:int,end:long>>>")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "n_weak", reported.alias("reported"), F.coalesce("credentials", empty).alias("credentials"))


def listed(spans, kinds: tuple[str, ...] = KINDS):
    """``kind:start:end`` of an array of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
