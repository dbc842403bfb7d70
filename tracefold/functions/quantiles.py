"""Exact quantiles by rank: equal values are counted first, a running sum over ranges of (key, value) gives every value its ranks, and only the values at wanted ranks go on.

No group's values are ever held together: a value that many rows share is one
row, and where a key has more distinct values than one task should take, the
running sum goes by cells (``scans``). A quantile between two ranks may need
values of two cells; both are kept and meet in the last, small aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import scan
from .tables import settle


def exact_quantiles(df: DataFrame, keys: list[str], value: str | Column, linear: dict[str, float], nearest: dict[str, float] | None = None, long: bool | None = None, cells: int | None = None) -> DataFrame:
    """Per key: n (values that are not null), by name the quantiles interpolated at (n - 1) p, and those of nearest rank ceil(n p). Keys without values have no row."""
    nearest = nearest or {}
    v = F.col(value) if isinstance(value, str) else value
    counted = settle(df.select(*keys, v.alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_k")))
    sizes = counted.groupBy(*keys).agg(F.sum("_k").alias("_n")).select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_n")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    rows = scan(counted, keys, ["_v"], total={"_upto": F.col("_k")}, long=long, cells=cells).join(sizes, same)

    def at(rank: Column) -> Column:
        """Whether a value stands at a rank from 0."""
        return (rank >= F.col("_upto") - F.col("_k")) & (rank < F.col("_upto"))

    place = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in linear.items()}
    ranks = {name: (F.floor(x), F.ceil(x)) for name, x in place.items()}
    ranks |= {name: (F.greatest(F.ceil(F.col("_n") * F.lit(float(p))), F.lit(1)) - 1,) * 2 for name, p in nearest.items()}
    wanted = reduce(lambda a, b: a | b, [at(low) | at(high) for low, high in ranks.values()])
    found = rows.where(wanted).groupBy(*keys, "_n").agg(*[F.max(F.when(at(r), F.col("_v"))).alias(f"_{name}_{i}") for name, pair in ranks.items() for i, r in enumerate(pair)])

    def between(name: str) -> Column:
        low, high = F.col(f"_{name}_0"), F.col(f"_{name}_1")
        if name in nearest:
            return low.cast("double")
        (below, above), x = ranks[name], place[name]
        return F.when(low == high, low.cast("double")).otherwise((above - x) * low + (x - below) * high)

    return found.select(*keys, F.col("_n").alias("n"), *[between(name).alias(name) for name in ranks])
