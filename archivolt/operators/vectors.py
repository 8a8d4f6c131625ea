"""Deterministic hash embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from archivolt.functions.text import let

DIM = 64


def hash_embedding(chunk_id: Column, text: Column, dim: int = DIM) -> Column:
    """array<double> of unit length from sha256(id, NUL, text, 2-byte counter): little-endian 32-bit words mapped to [-1, 1]."""
    seed = F.concat(F.encode(F.concat(chunk_id, F.lit("\u0000"), text), "utf-8"))
    rounds = F.transform(
        F.sequence(F.lit(0), F.lit(-(-dim // 8) - 1)),
        lambda i: F.sha2(F.concat(seed, F.unhex(F.lpad(F.hex(i.cast("bigint")), 4, "0"))), 256),
    )
    digest = F.array_join(rounds, "")

    def words(hexed: Column) -> Column:
        def word(i: Column) -> Column:
            swapped = F.concat(*[F.substring(hexed, i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1)])
            return F.conv(swapped, 16, 10).cast("double") / F.lit(4294967295.0) * 2.0 - 1.0

        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), word)

    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return let(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))

    return let(let(digest, words), scaled)
