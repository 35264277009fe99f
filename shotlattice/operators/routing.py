"""Which experts run on which segment: facts, a rule table and its decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: (order, expert, kind, fact that must hold; "" for always). Fixed values.
RULES = (
    (1, "visual", "global", ""), (2, "scene", "global", ""), (3, "tags", "global", ""), (4, "medium", "global", ""), (5, "depth", "global", ""), (6, "edges", "global", ""), (7, "semantic", "global", ""), (8, "panoptic", "global", ""),
    (9, "pose", "conditional", "person"), (10, "face", "conditional", "face"), (11, "emotion", "conditional", "face"), (12, "gaze", "conditional", "face"), (13, "text", "conditional", "text"), (14, "objects", "conditional", "object"),
)


def flags(df: DataFrame, keys: list[str], named: dict[str, Column], part: str) -> DataFrame:
    """Per segment and name: whether any part shows it, the most and the total on one part, and the share of parts that agree."""
    parts = df.groupBy(*keys, part).agg(*[F.sum(c.cast("long")).alias(n) for n, c in named.items()])
    out = parts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("parts"), *[f for n in named for f in (F.bool_or(F.col(n) > 0).alias(n), F.max(n).alias(f"{n}_max"), F.avg((F.col(n) > 0).cast("double")).alias(f"{n}_agreement"))]
    )
    return out


def facts(profile: DataFrame, names: list[str], floor: float) -> DataFrame:
    """Flags that hold and agree on at least ``floor`` of the parts; unknown agreement counts as full."""
    return profile.select("*", *[(F.col(n) & (F.coalesce(f"{n}_agreement", F.lit(1.0)) >= floor)).alias(f"{n}_fact") for n in names])


def decisions(segments: DataFrame, keys: list[str], names: list[str], route_all: bool = False) -> DataFrame:
    """(keys, ord, expert, kind, fired): every rule on every segment, in the rules' order."""
    rules = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(e).alias("expert"), F.lit(k).alias("kind"), (F.lit(True) if route_all or not n else F.col(f"{n}_fact") if n in names else F.lit(False)).alias("fired")) for o, e, k, n in RULES])
    return segments.select(*keys, F.explode(rules).alias("r")).select(*keys, "r.*")


def fired(decided: DataFrame, keys: list[str]) -> DataFrame:
    """Segments each expert runs on, and their share."""
    return decided.groupBy(*keys, "expert").agg(F.sum(F.col("fired").cast("long")).alias("n"), F.avg(F.col("fired").cast("double")).alias("share"))
