"""Operator 10: shard placement through a permutation-filled lookup table (DataFrame functions only).

Each shard has its own order of preference over the slots of a prime-sized table: it starts at
offset and goes on by skip, both hashed from its name, which visits every slot because the size is
prime.  Shards take turns claiming their next free slot until the table is full, so shares differ by
one slot at most, and when a shard leaves, few slots change hands.  The table has SLOTS rows whatever
the data's size, so broadcasting it is safe; placing a key is one hash and one lookup in it, without
a shuffle, and does not depend on how often a key or source occurs.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import spare_name

SLOTS = 65537
MAX_SLOTS = 1 << 22


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not _prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    at = [_number("offset:" + s) % slots for s in shards]
    skip = [_number("skip:" + s) % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            free -= 1
            if not free:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot: 60 bits of the MD5 of its text; null counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % slots


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard, shard_name), one row for each slot."""
    rows = ",".join(map(str, fill(shards, slots)))
    owners = F.from_json(F.lit(f"[{rows}]"), "array<int>")
    names = F.from_json(F.lit("[" + ",".join('"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"' for s in shards) + "]"), "array<string>")
    table = spark.range(1).select(F.posexplode(owners).alias("slot", "shard"))
    return table.select(F.col("slot").cast("long").alias("slot"), "shard", names[F.col("shard")].alias("shard_name"))


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """rows with slot (long), shard (int) and shard_name; clashing names get underscores at the end."""
    names = {c: spare_name(rows, c) for c in ("slot", "shard", "shard_name")}
    table = lookup_table(rows.sparkSession, shards, slots).select(*[F.col(c).alias(names[c]) for c in names])
    placed = rows.withColumn(names["slot"], slot_of(F.col(f"`{key}`"), slots))
    return placed.join(F.broadcast(table), names["slot"]).select(*[F.col(f"`{c}`") for c in rows.columns], *names.values())


def write_shards(placed: DataFrame, out: str, files_per_shard: int = 8, shard: str = "shard") -> None:
    """One folder for each shard; each is dealt over files_per_shard tasks, so that no task writes a whole shard."""
    salt = F.pmod(F.xxhash64(*[c for c, kind in placed.dtypes if not kind.startswith("map")]), F.lit(files_per_shard))
    placed.repartition(F.col(shard), salt).write.partitionBy(shard).parquet(out)


def placement_sql(shards: list[str], slots: int = SLOTS) -> str:
    """The same placement of documents in SQL, over the filled table."""
    owners = "[" + ",".join(map(str, fill(shards, slots))) + "]"
    return f"""WITH t AS (SELECT {owners} AS owners), d AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {slots} AS slot FROM documents)
SELECT doc_id, slot, owners[slot + 1] AS shard FROM d, t"""
