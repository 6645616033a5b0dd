"""Secrets in texts: patterns that count by themselves, and weak parts of credentials that count only together.

1. Each text is searched once. Three patterns count by themselves: an assignment to
   a name of a secret, an access key id, and a run of hexadecimal digits. Cheap tests
   of bytes keep the patterns from texts without a candidate. Texts that have both
   an identifier and a secret also give their weak parts: identifiers (names of
   users, accounts, clients), secrets (short or oddly named values, bare tokens of
   mixed characters) and endpoints (addresses of services).
2. An identifier's scope reaches `reach` code points to either side. Identifiers and
   secrets are linked by an interval join: parts go to the blocks of their text that
   they or their scopes touch, equal blocks meet, and a pair is kept in the first
   block that both touch. Endpoints are joined in the same way to the places within
   reach of both parts of a link. Parts of a kind don't overlap and have 3 code
   points at least, so a block holds few, and a text's blocks are spread like those
   of different texts.
3. Weak parts are reported where they are linked: an identifier and a secret by each
   other, an endpoint by a linked pair. Parts that overlap what counts by itself, or
   a part of a kind named before theirs, are no parts.

Letters match in either case in ASCII only, except in access keys and digits. Places
are code points, ends exclusive.

Defined cases: null and empty texts have no spans; spans at one place come in the
order of KINDS; repeated rows each get their spans; extra columns are ignored; no
rows give no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import stored, text_or_empty
from concord.llm.wordhash import slices, text_buffers

#: Names of spans in order; the first three count by themselves.
KINDS = ("assign", "access", "hex", "id", "url", "key")
SPAN = "struct<start: bigint, kind: int, stop: bigint>"
PART = "struct<start: bigint, stop: bigint, role: int, kind: int>"
IDENTIFIER, SECRET, ENDPOINT = range(3)
_ROLE = {0: SECRET, 1: IDENTIFIER, 2: SECRET, 3: IDENTIFIER, 4: ENDPOINT, 5: SECRET}

_GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
_FOLDED = re.IGNORECASE | re.ASCII
ASSIGN = re.compile(rf"(password|passwd|secret|token|api_?key){_GIVEN}([A-Za-z0-9+/_.=-]+)", _FOLDED)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Weak parts, by kind in order.
WEAK = (
    (3, re.compile(rf"(?<![a-z0-9])(?:user(?:_?name)?|login|uid|client_?id|account(?:_?id)?|access_?key(?:_?id)?){_GIVEN}[a-z0-9+/_.@-]{{3,}}", _FOLDED)),
    (3, re.compile(r"(?<![A-Z0-9])(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{8,}")),
    (4, re.compile(r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{0,30}://[^\s\"'<>]+", _FOLDED)),
    (4, re.compile(rf"(?<![a-z0-9])(?:host(?:_?name)?|server|endpoint|url){_GIVEN}[a-z0-9.:/_-]{{3,}}", _FOLDED)),
    (4, re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])")),
    (5, re.compile(rf"(?<![a-z0-9])(?:pass(?:word|wd|phrase)?|pwd|pw|secret(?:_?(?:access_?)?key)?|token|auth|credentials?|(?:private|api)_?key|signature){_GIVEN}[^\s\"'<>,;]{{4,}}", _FOLDED)),
    (5, re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}")),
)
#: A text without any of these has no identifier.
_NAMES = (b"user", b"login", b"uid", b"client", b"account", b"access", b"akia", b"asia", b"aroa", b"aida")
_SECRETS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_DIGIT = np.zeros(256, bool)
_DIGIT[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True


def with_long_digits(data: np.ndarray, at: np.ndarray) -> set[int]:
    """Texts that may hold a run of 24 hexadecimal digits; data and at: their bytes, and where each begins."""
    m = _DIGIT[data]
    for step in (1, 2, 4, 8, 8):  # places where runs of 2, 4, 8, 16, 24 begin
        m = m[:-step] & m[step:] if len(m) > step else m[:0]
    return set((np.searchsorted(at, np.flatnonzero(m), "right") - 1).tolist())


def base_spans(text: str, low: bytes, digits: bool) -> list[tuple[int, int, int]]:
    """start, kind, stop of what counts by itself, in order. low: the text's bytes, A-Z lower-cased; digits: whether it may hold a long run."""
    out = []
    if any(x in low for x in _SECRETS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"akia" in low:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if digits:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def parts_of(text: str, low: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """start, stop, role and kind of a text's parts, those that count by themselves included; none if it lacks identifiers or secrets."""
    if not any(x in low for x in _NAMES):
        return []
    taken = sorted((s, e) for s, _, e in base)
    parts = [(s, e, _ROLE[kind], kind) for s, kind, e in base]
    for kind, pattern in WEAK:
        starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
        fresh = []
        for m in pattern.finditer(text):
            before = bisect_left(starts, m.end())
            if not before or ends[before - 1] <= m.start():
                fresh.append((m.start(), m.end()))
        parts += [(s, e, _ROLE[kind], kind) for s, e in fresh]
        taken = sorted(taken + fresh)
        if kind == 3 and pattern is WEAK[1][1] and not any(p[2] == IDENTIFIER for p in parts):
            return []
    return sorted(parts) if any(p[2] == SECRET for p in parts) else []


def searched(docs: DataFrame) -> DataFrame:
    """row (a number of the row), doc_id, base (spans) and parts of every row, stored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.int64()
        span = pa.list_(pa.struct([("start", whole), ("kind", pa.int32()), ("stop", whole)]))
        part = pa.list_(pa.struct([("start", whole), ("stop", whole), ("role", pa.int32()), ("kind", pa.int32())]))
        for batch in batches:
            for some in slices(batch, 1):
                data, at = text_buffers(some.column(1))
                long, spans, parts = with_long_digits(data, at), [], []
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    low = data[a:b].tobytes().lower()
                    if k not in long and not any(x in low for x in _SECRETS) and not any(x in low for x in _NAMES):
                        spans.append([])
                        parts.append([])
                        continue
                    text = some.column(1)[k].as_py()
                    base = base_spans(text, low, k in long)
                    spans.append([dict(zip(("start", "kind", "stop"), x, strict=True)) for x in base])
                    parts.append([dict(zip(("start", "stop", "role", "kind"), x, strict=True)) for x in parts_of(text, low, base)])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(spans, span), pa.array(parts, part)], names=["doc_id", "base", "parts"])

    rows = docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text"))
    found = rows.mapInArrow(work, f"doc_id bigint, base array<{SPAN}>, parts array<{PART}>")
    return stored(found.select(F.monotonically_increasing_id().alias("row"), "*"), "searched")  # stored: the numbers stay


def _blocked(df: DataFrame, lo: Column, hi: Column, width: int) -> DataFrame:
    """df once for each block of `width` places that lo to hi touch; _first: the first of them."""
    first = F.floor(lo / width)
    return df.withColumn("_first", first).withColumn("_block", F.explode(F.sequence(first, F.floor(hi / width))))


def links(parts: DataFrame, reach: int = 200) -> DataFrame:
    """row, id_start, id_stop, id_kind, key_start, key_stop, key_kind, url_start, url_stop: every identifier with every secret in its scope, and the endpoints within reach of both, null if there are none.

    parts: row, start, stop, role, kind.
    """
    width = 2 * reach
    ids, keys, urls = (parts.where(F.col("role") == r).select("row", *[F.col(c).alias(f"{name}_{c}") for c in ("start", "stop", "kind")]) for r, name in ((IDENTIFIER, "id"), (SECRET, "key"), (ENDPOINT, "url")))
    near = lambda a, b: (F.col(f"{a}_start") - reach <= F.col(f"{b}_stop")) & (F.col(f"{b}_start") <= F.col(f"{a}_stop") + reach)
    scopes = _blocked(ids, F.col("id_start") - reach, F.col("id_stop") + reach, width).withColumnRenamed("_first", "_scope")
    pairs = scopes.join(_blocked(keys, F.col("key_start"), F.col("key_stop"), width), ["row", "_block"])
    pairs = pairs.where(near("id", "key") & (F.col("_block") == F.greatest("_scope", "_first"))).drop("_block", "_first", "_scope")
    # within reach of both: from the later start to the earlier end, as far as the reach
    lo, hi = F.greatest("id_start", "key_start") - reach, F.least("id_stop", "key_stop") + reach
    meet = _blocked(pairs, lo, hi, width).withColumnRenamed("_first", "_scope")
    found = meet.join(_blocked(urls, F.col("url_start"), F.col("url_stop"), width), ["row", "_block"])
    found = found.where(near("id", "url") & near("key", "url") & (F.col("_block") == F.greatest("_scope", "_first"))).drop("_block", "_first", "_scope", "url_kind")
    alone = pairs.join(found.select("row", "id_start", "key_start").distinct(), ["row", "id_start", "key_start"], "left_anti")
    return found.unionByName(alone, allowMissingColumns=True)


def spans(docs: DataFrame, reach: int = 200) -> DataFrame:
    """doc_id, base and spans (start, kind, stop, in order; kind: an index of KINDS) of every row of docs."""
    found = searched(docs)
    some = found.where(F.size("parts") > 0)
    parts = some.select("row", F.inline("parts"))
    linked = stored(links(parts, reach), "links")
    each = F.inline(F.array(*[F.struct(F.col(f"{c}_start").alias("start"), kind.cast("int").alias("kind"), F.col(f"{c}_stop").alias("stop")) for c, kind in (("id", F.col("id_kind")), ("key", F.col("key_kind")), ("url", F.lit(4)))]))
    weak = linked.select("row", each).where((F.col("kind") > 2) & F.col("start").isNotNull())
    weak = weak.groupBy("row").agg(F.collect_set(F.struct("start", "kind", "stop")).alias("weak"))
    both = some.join(weak, "row", "left").select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("weak", F.array().cast(f"array<{SPAN}>")))).alias("spans"))
    return found.where(F.size("parts") == 0).select("doc_id", "base", F.col("base").alias("spans")).unionByName(both)


def spelled(spans_: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    name = lambda s: F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame, reach: int = 200) -> DataFrame:
    """doc_id, counts of the three kinds that count by themselves, the digest of their spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return spans(docs, reach).select("doc_id", *[count(k) for k in range(3)], F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
