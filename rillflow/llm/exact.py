"""Exact dedup through a minimal perfect hash over historical distinct digests.

The history's distinct digests are dealt to shards of some thousands; each shard gets a hash-and-displace
function whose slots are exactly as many as its digests. A slot holds the full digest and the locator of the
row that stays, so a lookup is two equi-joins (bucket to displacement, slot to entry) and a comparison of all
bytes; rows whose bytes differ are no members and are grouped among themselves.
"""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import id_and_text, keep, keep_rows, tasks_for

#: Digests of a shard on average, and buckets of a shard.
SHARD, BUCKETS = 4096, 1024
#: Pairs of hash values that a digest offers, tried in turn by a shard; then the digest is hashed anew, so often at most.
PAIRS, LEVELS = 9, 12

SLOTS_SCHEMA = "shard long, bucket long, attempt int, d0 long, d1 long, n_slots long, slot long, digest string, keep_id long, keep_row long, group_size long"


def normalised(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _number(digest: Column, start: int | Column, digits: int) -> Column:
    start = F.lit(start) if isinstance(start, int) else start
    return F.conv(F.substr(digest, start, F.lit(digits)), 16, 10).cast("long")


def _addressed(rows: DataFrame, digest: str, shards: int) -> DataFrame:
    d = F.col(digest)
    return rows.withColumns({"shard": F.pmod(_number(d, 1, 12), F.lit(shards)), "bucket": F.pmod(_number(d, 13, 8), F.lit(BUCKETS))})


def _anew(digest: Column, level: Column) -> Column:
    return F.when(level == 0, digest).otherwise(F.sha2(F.concat(level.cast("string"), F.lit(":"), digest), 256))


def _words(digests: pd.Series, start: int) -> np.ndarray:
    return np.array([int(d[start - 1 : start + 7], 16) for d in digests], np.int64)


def displace(h1: np.ndarray, h2: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """``(d0, d1, slot)`` by key so that ``(h1 + d0 * h2 + d1) mod n`` is a bijection, one pair a bucket; None if these values allow none."""
    n = len(h1)
    h1, h2 = h1 % n, h2 % n
    d0, d1, slot = (np.zeros(n, np.int64) for _ in range(3))
    free = np.ones(2 * n, bool)
    order = np.argsort(bucket, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
    for keys in sorted(groups, key=len, reverse=True):
        for a in range(n):
            at = (h1[keys] + a * h2[keys]) % n
            if len(set(at.tolist())) < len(keys):
                if a and len(set(zip(h1[keys].tolist(), h2[keys].tolist(), strict=True))) < len(keys):
                    return None
                continue
            fits = free[at[0] : at[0] + n].copy()
            for p in at[1:]:
                fits &= free[p : p + n]
            b = int(fits.argmax())
            if fits[b]:
                at = (at + b) % n
                free[at] = free[at + n] = False
                d0[keys], d1[keys], slot[keys] = a, b, at
                break
        else:
            return None
    return d0, d1, slot


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    shard = shard.sort_values("digest")
    bucket = shard["bucket"].to_numpy()
    for attempt in range(PAIRS * LEVELS):
        level, pair = divmod(attempt, PAIRS)
        digest = shard["digest"] if not level else shard["digest"].map(lambda d: hashlib.sha256(f"{level}:{d}".encode()).hexdigest())  # noqa: B023
        if found := displace(_words(digest, 21 + 2 * pair), _words(digest, 41 + 2 * pair), bucket):
            d0, d1, slot = found
            return shard.assign(attempt=np.int32(attempt), d0=d0, d1=d1, slot=slot, n_slots=len(shard))[[c.split()[0] for c in SLOTS_SCHEMA.split(", ")]]
    raise ValueError(f"no displacement fits a shard of {len(shard)} digests")


def digests(docs: DataFrame) -> DataFrame:
    """``row_no, doc_id, digest, h`` of every row, as a table; null texts count as empty; ``h`` is a hash of id and text as they are."""
    rows = id_and_text(docs)
    return keep(rows.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", F.sha2(normalised(F.col("text")), 256).alias("digest"), F.xxhash64("doc_id", "text").alias("h")), "digests")


def build_index(rows: DataFrame) -> DataFrame:
    """The slots of a minimal perfect hash over the distinct digests of ``rows(row_no, doc_id, digest)``.

    Of rows with one digest the largest ``(doc_id, row_no)`` is located (a null id is the smallest). Grouping
    combines before the shuffle; a shard's size depends on distinct digests alone, so copies don't swell it.
    """
    distinct = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row_no")).alias("w"), F.count("*").alias("group_size"))
    distinct = keep(distinct.select("digest", F.col("w.doc_id").alias("keep_id"), F.col("w.row_no").alias("keep_row"), "group_size"), "distinct")
    shards = tasks_for(distinct.count(), SHARD)
    return keep(_addressed(distinct, "digest", shards).groupBy("shard").applyInPandas(_build, SLOTS_SCHEMA), "slots")


def look_up(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``rows(row_no, doc_id, digest)`` with ``keep_id, keep_row, group_size`` of their slot, null where its digest differs."""
    shards = index.agg(F.coalesce(F.max("shard") + 1, F.lit(1))).first()[0]  # shards hold thousands each, the last one too
    pilots = index.select("shard", "bucket", "attempt", "d0", "d1", "n_slots").distinct()
    slots = index.select("shard", "slot", F.col("digest").alias("slot_digest"), "keep_id", "keep_row", "group_size")
    at = _addressed(rows, "digest", shards).join(pilots, ["shard", "bucket"], "left")
    attempt = F.coalesce("attempt", F.lit(0))
    at = at.withColumn("hashed", _anew(F.col("digest"), F.floor(attempt / PAIRS)))
    h1, h2 = (_number(F.col("hashed"), F.lit(start) + 2 * (attempt % PAIRS), 8) for start in (21, 41))
    at = at.withColumn("slot", F.pmod(F.pmod(h1, "n_slots") + F.col("d0") * F.pmod(h2, "n_slots") + F.col("d1"), "n_slots"))
    hit = at.select("row_no", "doc_id", "digest", "shard", "slot").join(slots, ["shard", "slot"], "left")
    same = F.col("slot_digest") == F.col("digest")
    return hit.select("row_no", "doc_id", "digest", *(F.when(same, F.col(c)).alias(c) for c in ("keep_id", "keep_row", "group_size")), F.coalesce(same, F.lit(False)).alias("member"))


def _winners(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row_no")).alias("w"), F.count("*").alias("size"))


def classes(rows: DataFrame) -> DataFrame:
    """``digest, keep_id, keep_row, group_size`` of each distinct digest of ``rows(row_no, doc_id, digest)``, as a table.

    Half of the rows, by a hash of the id, are history and are indexed; the others come in and are looked up.
    Members are repeats: they raise the size of their slot's group and move its locator where their id is
    larger. Nonmembers are grouped separately.
    """
    old = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0
    index = build_index(rows.where(old))
    found = keep(look_up(rows.where(~old), index), "found")
    came = _winners(found.where("member")).select(F.col("digest").alias("__digest"), "w", "size")
    stood = index.select("digest", F.struct(F.col("keep_id").alias("doc_id"), F.col("keep_row").alias("row_no")).alias("stood"), "group_size")
    moved = stood.join(came, F.col("digest") == F.col("__digest"), "left")
    moved = moved.select("digest", F.greatest("stood", "w").alias("w"), (F.col("group_size") + F.coalesce("size", F.lit(0))).alias("size"))
    both = moved.unionByName(_winners(found.where("NOT member")).select("digest", "w", "size"))
    return keep(both.select("digest", F.col("w.doc_id").alias("keep_id"), F.col("w.row_no").alias("keep_row"), F.col("size").alias("group_size")), "classes")


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs(doc_id, text)``.

    Texts are equal when identical after lower-casing A-Z; of equal rows the largest ``doc_id`` stays, of
    rows that repeat an id too the last one in the table. Without ``history`` one half of the table is the
    history of the other (``classes``). With ``history`` (an index from ``build_index``) its members are
    repeats, never kept, and located there; the others are grouped among themselves. Null texts count as
    empty; a null id stays only if its group has no other; an empty table gives no rows. Other columns are
    not read.
    """
    rows = digests(docs)
    cols = ("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
    if history is None:
        of = classes(rows).withColumnRenamed("digest", "__digest")
        return rows.join(of, F.col("digest") == F.col("__digest")).withColumn("kept", F.col("row_no") == F.col("keep_row")).select(*cols)
    found = keep(look_up(rows, history), "found")
    own = keep(_winners(found.where("NOT member")), "own").withColumnRenamed("digest", "__digest")
    rest = found.where("NOT member").select("row_no", "doc_id", "digest").join(own, F.col("digest") == F.col("__digest"))
    rest = rest.withColumns({"keep_id": F.col("w.doc_id"), "kept": F.col("row_no") == F.col("w.row_no"), "group_size": F.col("size")})
    return found.where("member").withColumn("kept", F.lit(False)).select(*cols).unionByName(rest.select(*cols))


def keep_distinct(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns; the texts of rows that stay don't move, but for about one in 200."""
    rows = digests(docs)
    of = classes(rows).withColumnRenamed("digest", "__digest")
    rows = keep(rows.join(of, F.col("digest") == F.col("__digest")).select("doc_id", "digest", "h", "keep_id", "group_size"), "rows")
    # Of a group that has one id, or none, the rows repeat it.
    copies = rows.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("group_size") > 1)).groupBy(F.col("digest").alias("__digest")).agg(F.count("*").alias("copies"))
    rows = rows.join(copies, F.col("digest") == F.col("__digest"), "left")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return keep_rows(docs, rows.select("doc_id", "digest", "h", stays.alias("stays"), F.when(stays, F.coalesce("copies", F.lit(1))).otherwise(F.lit(1)).alias("n")), normalised(F.coalesce(F.col("text"), F.lit(""))))
