"""Secret scans with corpus-wide ownership frequency.

Texts are scanned for three base kinds and for other opaque tokens. Every candidate's value is hashed; per hash the
distinct repositories (documents) and owners (sources) that hold it are counted. A value that more than ``max_owners``
owners hold is an example that everyone copies; one that stays with so many looks like somebody's live credential,
however many repositories of theirs hold it (``max_repos`` bounds them too, if given). Base spans are always reported;
an opaque token becomes a span of kind ``owned`` only if its value is owner-specific.

Base kinds (fixed values): assign, access, hex; leftmost non-overlapping matches, the short ones dropped afterwards.
Spans are whole matches in code points, end exclusive.

Defined results: a null or empty text has no spans; a null owner is one more owner; a null id counts as one repository;
rows that repeat an id are one repository for the counts, whoever their owners are, and each is returned with its own
spans; of candidates with one start, kinds come as listed; an empty table gives an empty one; extra columns play no
part. Whole texts are scanned however long they are, in time and memory that grow with their length.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, hot_join, pieces, written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the whole run, so as good as dropping short ones afterwards
HEX = re.compile(r"[0-9a-f]{24,}")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "owned")


def entropy(value: str) -> float:
    """Bits per character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def opaque(value: str) -> bool:
    """Mixed letters and digits without the look of words: what generated credentials are made of."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= 3.5


def spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value): base matches and, outside of them, opaque tokens."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base, i, reach = sorted((s, e) for s, _, e, _ in found), 0, 0  # reach: how far those that start before m ends go
    for m in OPAQUE.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            reach = max(reach, base[i][1])
            i += 1
        if reach <= m.start() and opaque(m[0]):
            found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found)


def joined(found: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in found)


def candidates(docs: DataFrame, owner: str = "source") -> DataFrame:
    """Written, one row per row of ``docs``: rid, doc_id, owner, base counts and digest, found (start, kind, end, 128-bit hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("hash", pa.binary())]))
        for batch in batches:
            for part in pieces(batch, "text"):
                out = [spans(t or "") for t in part.column("text").to_pylist()]
                base = [[x for x in found if x[1] < 3] for found in out]
                counts = [pa.array([sum(x[1] == k for x in found) for found in base], pa.int64()) for k in range(3)]
                sha = pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base])
                found = pa.array([[{"start": s, "kind": k, "end": e, "hash": xxhash.xxh3_128_digest(v)} for s, k, e, v in x] for x in out], kind)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("owner"), *counts, sha, found], ["doc_id", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    here = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col("text"))
    schema = "doc_id long, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:int,kind:int,end:int,hash:binary>>"
    return written(here.mapInArrow(run, schema).withColumn("rid", F.monotonically_increasing_id()), "candidates")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners, n_rows over the rows of ``candidates``: all counts combine on the map side, key by key."""
    owner = F.concat(F.when(F.col("owner").isNull(), "0").otherwise("1"), F.coalesce("owner", F.lit("")))
    flat = found.where(F.size("found") > 0).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("repo"), owner.alias("owner"), F.explode("found.hash").alias("hash"))
    pairs = flat.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    counted = [pairs.groupBy("hash", c).agg(F.sum("n").alias("n")).groupBy("hash").agg(F.count("*").alias(f"n_{c}s"), F.sum("n").alias("n_rows")) for c in ("repo", "owner")]
    return counted[0].join(counted[1].drop("n_rows"), "hash")


def scanned(docs: DataFrame, owner: str = "source", max_owners: int = 1, max_repos: int | None = None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example (candidates by verdict)."""
    rows = candidates(docs, owner)
    live = F.col("n_owners") <= max_owners
    if max_repos is not None:
        live = live & (F.col("n_repos") <= max_repos)
    verdict = written(ownership(rows).select("hash", live.alias("live"), "n_rows"), "verdicts", few=True)
    flat = rows.where(F.size("found") > 0).select("rid", F.explode("found").alias("x")).select("rid", "x.start", "x.kind", "x.end", F.col("x.hash").alias("hash"))
    total = verdict.agg(F.sum("n_rows")).first()[0] or 0
    held = hot_join(flat, verdict, ["hash"], "n_rows", total, "rid").groupBy("rid").agg(
        F.collect_list(F.when((F.col("kind") < 3) | F.col("live"), F.struct("start", "kind", "end"))).alias("s"), F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example")
    )
    name = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(F.array_sort("s"), lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    out = rows.drop("found", "owner").join(held.select("rid", text.alias("spans"), "n_live", "n_example"), "rid", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_example")]
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), *zero)
