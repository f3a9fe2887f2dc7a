"""Filling nulls through functional dependencies.

A null in column c is filled from its group when the group holds exactly one
distinct non-null c. min and max are mergeable, so one aggregate with a map-side
combine decides this for all columns; distinct counts would multiply the rows.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions import text
from trackloom.operators.skew import join_salted, shuffled
from trackloom.schemas import RAW_TRACK_COLUMNS
from trackloom.session import cut_lineage

BY_TRACK_ID = [c for c in RAW_TRACK_COLUMNS if c != "track_id"]
BY_ARTIST_TRACK = [c for c in RAW_TRACK_COLUMNS if c not in ("artist_name", "track_name")]


# Columns that few groups can fill: at most this many groups in all are broadcast.
RARE_KEYS = 50_000


def unique_values(df: DataFrame, key: str, targets: list[str]) -> DataFrame:
    """Per non-null key: the single value of each target, else null."""
    grouped = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        *[f(c).alias(f"_{f.__name__}_{c}") for c in targets for f in (F.min, F.max)])
    return grouped.select(key, *[
        F.when(F.col(f"_min_{c}") == F.col(f"_max_{c}"), F.col(f"_min_{c}")).alias(f"_fill_{c}") for c in targets])


def fill_from_group(df: DataFrame, key: str, targets: list[str], marks: str | None = None) -> DataFrame:
    """Fill all targets in one join; rows with a null key stay as they are.

    Only rows with a gap that many groups can fill are shuffled; gaps that few groups
    can fill are looked up in a broadcast table of at most RARE_KEYS groups. ``marks``
    adds a bit mask column: bit i is set where targets[i] was filled.
    """
    gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in targets]).first()
    gappy = [c for c in targets if gaps[c]]
    filled_by = {c: F.col(f"_fill_{c}") for c in gappy}
    lookup = cut_lineage(unique_values(df, key, targets).select(key, *filled_by.values()).where(_any(filled_by.values())))
    able = lookup.agg(F.count(F.lit(1)).alias("_groups"), *[F.count(v).alias(c) for c, v in filled_by.items()]).first()
    rare, groups = [], 0
    for c in sorted((c for c in gappy if able[c]), key=lambda c: able[c]):
        groups += able[c]
        if groups <= RARE_KEYS:
            rare.append(c)
    common = [c for c in gappy if able[c] and c not in rare]

    def filled(rows, by):
        out = [F.coalesce(c, filled_by[c]).alias(c) if c in by else F.col(c) for c in df.columns]
        if marks:
            out.append(_mask([F.col(c).isNull() & filled_by[c].isNotNull() if c in by else F.lit(False) for c in targets]).alias(marks))
        return rows.select(*out)

    wide = _any([F.col(c) for c in common], F.isnull)
    keyed = df.where(F.col(key).isNotNull())
    kept = keyed.where(~wide)
    if rare:
        few = lookup.select(key, *[filled_by[c] for c in rare]).where(_any(filled_by[c] for c in rare))
        kept = kept.join(F.broadcast(few), key, "left")
    done = filled(kept, rare).unionByName(filled(df.where(F.col(key).isNull()), []))
    if not common:
        return done
    return done.unionByName(filled(join_salted(keyed.where(wide), shuffled(lookup), key), gappy))


def _any(columns, test=F.isnotnull) -> Column:
    return reduce(or_, [test(c) for c in columns], F.lit(False))


def _mask(bits: list[Column]) -> Column:
    total = F.lit(0)
    for i, bit in enumerate(bits):
        total = total + F.when(bit, 1 << i).otherwise(0)
    return total


def fill_by_track_id(df: DataFrame, marks: str | None = None) -> DataFrame:
    return fill_from_group(df, "track_id", BY_TRACK_ID, marks)


def fill_by_artist_track(df: DataFrame, marks: str | None = None) -> DataFrame:
    """The key is built after any earlier pass, from the values it filled."""
    keyed = df.withColumn("artist_track_key", text.artist_track_key(F.col("artist_name"), F.col("track_name")))
    return fill_from_group(keyed, "artist_track_key", BY_ARTIST_TRACK, marks).drop("artist_track_key")


def deterministic_fill(df: DataFrame, marks: bool = False) -> DataFrame:
    """Both passes. With ``marks``, columns _pass1 and _pass2 hold the bit masks.

    Each pass reads its input several times (lookup, hot keys, rows), so what a
    pass starts from is written to the shared folder once.
    """
    first = cut_lineage(fill_by_track_id(cut_lineage(df), "_pass1" if marks else None))
    return fill_by_artist_track(first, "_pass2" if marks else None)


def fill_counts(marked: DataFrame) -> DataFrame:
    """(metric, column, value) fill counts per pass from the bit masks, in one pass."""
    passes = [("_pass1", "fill_track_id", BY_TRACK_ID), ("_pass2", "fill_artist_track", BY_ARTIST_TRACK)]
    wide = marked.agg(*[
        F.count_if(F.col(mask).bitwiseAND(1 << i) != 0).alias(f"{name}|{c}")
        for mask, name, targets in passes if mask in marked.columns for i, c in enumerate(targets)])
    name = F.split("name", r"\|")
    return wide.unpivot([], wide.columns, "name", "value").select(
        name[0].alias("metric"), name[1].alias("column"), "value")
