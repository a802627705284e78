"""Effort sizing, report roll-ups and catalogue inheritance."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import _cut
from quarry.operators.spread import pairs

#: Fixed values of the sizing model: anchor, windows relative to it, reach of each dimension, ends of the point scale, band ends, deck.
ANCHOR = 87.5
WINDOWS = {"effort": (0.35, 2.40), "complexity": (0.35, 1.40), "uncertainty": (0.00, 0.50)}
REACH = {"effort": 0.88, "complexity": 0.50, "uncertainty": 0.20}
POINTS = (2.0, 8.0)
BANDS = {"SMALL": 2.5, "MEDIUM": 4.0, "LARGE": 6.5}
DECK = (1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0, 34.0, 55.0, 89.0, 144.0, 233.0, 377.0)
#: Volume and uncertainty weights, and parity weights.
VOLUME = {"chunk": 0.5, "line": 0.01, "step": 1.0, "io": 1.0, "param": 0.5}
UNCERTAIN = {"unresolved_ref": 3.0, "unclosed_block": 4.0, "unknown_chunk": 2.0, "diagnostic": 1.5}
PARITY = {"DIRECT": 0.0, "SUPPORTED": 0.5, "PARTIAL": 1.5, "HARD": 3.0, "MANUAL": 5.0}
TIERS = {"LOW": 1.0, "MEDIUM": 2.5, "HIGH": 5.0}


def weighted(weights: dict[str, float]) -> Column:
    """The sum of columns named like the weights."""
    return reduce(lambda a, b: a + b, (F.coalesce(F.col(k), F.lit(0)) * w for k, w in weights.items()))


def normalised(dimension: str, raw: Column, anchor: float = ANCHOR) -> Column:
    lo, hi = (x * anchor for x in WINDOWS[dimension])
    span = math.log1p(hi) - math.log1p(lo)
    return F.least(F.greatest((F.log1p(F.greatest(raw, F.lit(0.0))) - math.log1p(lo)) / span, F.lit(0.0)), F.lit(1.0))


def blend(effort: Column, complexity: Column, uncertainty: Column, anchor: float = ANCHOR) -> Column:
    raws = {"effort": effort, "complexity": complexity, "uncertainty": uncertainty}
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, (normalised(d, c, anchor) * REACH[d] for d, c in raws.items())))


def points(blended: Column) -> Column:
    """Geometric between the ends of the scale."""
    lo, hi = POINTS
    return F.round(lo * F.pow(F.lit(hi / lo), blended), 2)


def band(p: Column) -> Column:
    out = F.when(p <= BANDS["SMALL"], "SMALL")
    for name in ("MEDIUM", "LARGE"):
        out = out.when(p <= BANDS[name], name)
    return out.otherwise("EXTRA_LARGE")


def snap(value: Column, deck: tuple[float, ...] = DECK) -> Column:
    """The deck's entry nearest in ratio, the smaller of equals."""
    held = F.least(F.greatest(value, F.lit(deck[0])), F.lit(deck[-1]))
    options = F.array(*[F.struct(F.abs(F.ln(F.lit(f) / held)).alias("d"), F.lit(f).alias("f")) for f in deck])
    return F.array_min(options)["f"]


def covered_lines(spans: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """by, lines that overlapping spans cover, each once; without expanding spans to lines."""
    w = Window.partitionBy(by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(end).over(w), F.col(start) - 1)
    fresh = F.greatest(F.col(end) - F.greatest(seen, F.col(start) - 1), F.lit(0))
    return spans.withColumn("_fresh", fresh).groupBy(by).agg(F.sum("_fresh").alias("lines"))


def ordered_names(df: DataFrame, by: str, name: str, pos: str) -> DataFrame:
    """by, names: each name once, case aside, in its first spelling and order."""
    first = df.groupBy(by, F.lower(name).alias("_k")).agg(F.min(F.struct(pos, name)).alias("_f"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list("_f")), lambda x: x[name]).alias("names"))


def roll_up_signals(signals: DataFrame, by: str, name: str, tier: str) -> DataFrame:
    """by, tier (the highest), score: each distinct construct counts once."""
    rank = F.when(F.col(tier) == "HIGH", 3).when(F.col(tier) == "MEDIUM", 2).otherwise(1)
    weight = F.when(F.col(tier) == "HIGH", TIERS["HIGH"]).when(F.col(tier) == "MEDIUM", TIERS["MEDIUM"]).otherwise(TIERS["LOW"])
    once = signals.groupBy(by, name).agg(F.max(F.struct(rank.alias("r"), weight.alias("w"))).alias("s"))
    top = F.max("s.r")
    return once.groupBy(by).agg(F.when(top == 3, "HIGH").when(top == 2, "MEDIUM").otherwise("LOW").alias("tier"), F.sum("s.w").alias("score"))


def inherit(parent: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """A child catalogue over its parent's: field by field, the child's value where it states one."""
    fields = [c for c in parent.columns if c != key]
    p, c = parent.alias("p"), child.alias("c")
    j = p.join(c, F.col(f"p.{key}") == F.col(f"c.{key}"), "full_outer")
    return j.select(F.coalesce(f"c.{key}", f"p.{key}").alias(key), *[F.coalesce(f"c.{f}", f"p.{f}").alias(f) if f in child.columns else F.col(f"p.{f}").alias(f) for f in fields])


def lineage(profiles: DataFrame) -> DataFrame:
    """profile, ancestor, distance of every profile and the chain above it, itself at 0; profiles: profile, parent (null: none).

    Chains are followed by doubling, so rounds are the logarithm of their length. Chains that close, unknown parents and profiles with two parents raise.
    """
    own = profiles.where("profile is not null").select("profile", "parent").distinct()
    twice = own.groupBy("profile").count().where("count > 1").select("profile")
    lost = own.where("parent is not null").join(own.select(F.col("profile").alias("parent")), "parent", "left_anti").select("profile")
    for what, rows in (("has two parents", twice), ("has a parent that is no profile", lost)):
        bad = rows.take(1)
        if bad:
            raise ValueError(f"profile {bad[0].profile} {what}")
    ups = _cut(own.where("parent is not null").select("profile", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("distance")))
    reach, size = ups, ups.count()
    while True:
        a, b = reach.alias("a"), reach.alias("b")
        further = a.join(b, F.col("a.ancestor") == F.col("b.profile")).select("a.profile", "b.ancestor", (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        reach = _cut(reach.union(further).distinct(), reach)
        closed = reach.where("profile = ancestor").take(1)
        if closed:
            raise ValueError(f"profile {closed[0].profile} inherits from itself")
        before, size = size, reach.count()
        if size == before:
            return own.select("profile", F.col("profile").alias("ancestor"), F.lit(0).cast("long").alias("distance")).union(reach)


def _over_levels(profiles: DataFrame, own: DataFrame, nearest: list[Column], *key: str) -> DataFrame:
    """profile, key and `nearest` over the statements (own: ancestor, key) of each profile and those above it.

    Only profiles that state something are worked out, by grouping what their chains state; the others take all that the nearest of these has.
    """
    own, chains = _cut(own), lineage(profiles)
    says = own.select("ancestor").distinct()
    at = chains.join(says, "ancestor").groupBy("profile").agg(F.min(F.struct("distance", "ancestor"))["ancestor"].alias("_at"))
    stating = chains.join(says.select(F.col("ancestor").alias("profile")), "profile", "left_semi")
    full = stating.join(own, "ancestor").groupBy(F.col("profile").alias("_at"), *key).agg(*nearest)
    return pairs(full, at, "_at", F.xxhash64(*key)).drop("_at")


def catalogue(profiles: DataFrame, entries: DataFrame, groups: DataFrame, fields: list[str]) -> DataFrame:
    """profile, kind, name, fields, stated_by: what each profile rates, the nearest statement above it winning as a whole.

    entries: profile, kind, name, fields. groups: profile, group_no, kind, names (array), fields; a group stands for its names, a later group for those of
    an earlier one, and an entry of the same profile for those of all groups. Names are compared case aside; rows without a profile, kind or name are
    left out. Of repeated entries of a profile the greatest counts.
    """
    value = F.struct(*fields).alias("value")
    named = entries.select("profile", "kind", F.lower("name").alias("name"), F.lit(1).alias("named"), F.lit(0).cast("long").alias("no"), value)
    grouped = groups.select("profile", "kind", F.explode("names").alias("name"), F.lit(0).alias("named"), F.col("group_no").cast("long").alias("no"), value).withColumn("name", F.lower("name"))
    said = named.unionByName(grouped).where("profile is not null and kind is not null and name is not null")
    own = said.groupBy(F.col("profile").alias("ancestor"), "kind", "name").agg(F.max(F.struct("named", "no", "value")).alias("s"))
    near = _over_levels(profiles, own, [F.min(F.struct("distance", "ancestor", "s")).alias("n")], "kind", "name")
    return near.select("profile", "kind", "name", *[F.col(f"n.s.value.{f}").alias(f) for f in fields], F.col("n.ancestor").alias("stated_by"))


def flags(profiles: DataFrame, stated: DataFrame, fields: list[str]) -> DataFrame:
    """profile, name, fields: flags merge field by field, each from the nearest profile above that states it; stated: profile, name, fields."""
    once = stated.where("profile is not null and name is not null").groupBy(F.col("profile").alias("ancestor"), "name").agg(*[F.max(f).alias(f) for f in fields])
    nearest = [F.min(F.when(F.col(f).isNotNull(), F.struct("distance", F.col(f).alias("v"))))["v"].alias(f) for f in fields]
    return _over_levels(profiles, once, nearest, "name").select("profile", "name", *fields)


def allowed(uses: DataFrame, rated: DataFrame, fields: list[str]) -> DataFrame:
    """Uses (profile, kind, name and what else they hold) with their profile's ratings, and listed: whether the profile has an entry at all."""
    u = uses.withColumn("_name", F.lower("name"))
    r = rated.select("profile", "kind", F.col("name").alias("_name"), *fields, F.lit(True).alias("_listed"))
    return u.join(r, ["profile", "kind", "_name"], "left").select(*uses.columns, *fields, F.coalesce("_listed", F.lit(False)).alias("listed"))


def hardest(df: DataFrame, n: int, tier: str = "tier", score: str = "score", key: str = "key") -> DataFrame:
    rank = F.when(F.col(tier) == "HIGH", 3).when(F.col(tier) == "MEDIUM", 2).otherwise(1)
    return df.orderBy(rank.desc(), F.col(score).desc(), key).limit(n)


def io_roles(rows: DataFrame, name: str, reads: str, writes: str) -> DataFrame:
    """name, role: intermediate if it is read and written, input if only read, output if only written. reads, writes: 0 or 1 by row."""
    g = rows.groupBy(name).agg(F.max(reads).alias("_r"), F.max(writes).alias("_w"))
    return g.select(name, F.when((F.col("_r") == 1) & (F.col("_w") == 1), "intermediate").when(F.col("_r") == 1, "input").otherwise("output").alias("role"))
