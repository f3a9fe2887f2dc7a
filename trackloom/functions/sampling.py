"""Seeded hashes for splits and samples: same rows on any cluster layout."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.schemas import SEED

HASH_RANGE = 1 << 32


def hash32(key: Column, seed: int | str = SEED) -> Column:
    """Uniform integer in [0, 2**32) from the first 8 hex digits of an md5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def is_held_out(key: Column, share: float = 0.2, seed: int | str = SEED) -> Column:
    return hash32(key, seed) % 10000 < int(round(share * 10000))


def fold(key: Column, k: int, seed: int | str = SEED) -> Column:
    return (hash32(key, seed) % k).cast("int")
