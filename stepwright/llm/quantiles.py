"""Exact percentiles per group by bisection with counts, for data of any size and in several deliveries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

#: An interval with at most this many rows is not halved any more but finished by sorting them; 1 halves to the end.
SORT_AT = 1
#: Counted parts of an interval in a pass; 2 is plain bisection, 2 ** k does k halvings at once.
PARTS = 64


def sort_key(value: Column) -> Column:
    """A BIGINT in the order of the doubles: bisection on it ends after 64 halvings whatever their range."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF)))


def slots_of(requests: DataFrame) -> list[tuple[int, str, str]]:
    """The different pairs of field and grouping that requests names, numbered; requests is a small table."""
    pairs = requests.select("field", "group_field").distinct().collect()
    return [(i, r[0], r[1]) for i, r in enumerate(sorted(pairs, key=lambda r: (str(r[0]), str(r[1]))))]


def requested_values(frame: DataFrame, slots: list, id_col: str, groups: dict[str, Column]) -> DataFrame:
    """One row per slot and read with a value: (slot, group_value, read, value).

    groups maps names of groupings to expressions of a string. Null and NaN are missing; infinite
    values count like others. Slots with an unknown field or grouping have no rows.
    """
    numbers = {c for c, t in frame.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")}
    cells = [
        F.struct(
            F.lit(slot).alias("slot"),
            groups[by].cast("string").alias("group_value"),
            F.col(field).cast("double").alias("value"),
        )
        for slot, field, by in slots
        if field in numbers and by in groups
    ]
    none = F.lit(None).cast("array<struct<slot:int,group_value:string,value:double>>")
    return (
        frame.select(F.col(id_col).alias("read"), F.explode(F.array(*cells) if cells else none).alias("c"))
        .select("c.slot", "c.group_value", "read", F.nanvl("c.value", F.lit(None).cast("double")).alias("value"))
        .where("value is not null")
    )


def once_per_group(values: DataFrame) -> DataFrame:
    """Each read once per slot and group: delivered again or listed under two runs, it still counts once.

    values has a column delivery. A read in several deliveries counts in the first, with its
    smallest value there. A read without id is a read of its own.
    """
    named = values.where("read is not null").groupBy("slot", "group_value", "read").agg(
        F.min(F.struct("delivery", "value")).alias("f")
    )
    once = named.select("slot", "group_value", "f.delivery", "f.value").unionByName(
        values.where("read is null").select("slot", "group_value", "delivery", "value")
    )
    return once.withColumn("value", F.col("value") + 0.0).withColumn("key", sort_key(F.col("value")))


def _half(key: str) -> Column:
    """Half a key: differences of halves fit a BIGINT."""
    return F.shiftright(key, 1)


def _counts(delivery: DataFrame, open_: DataFrame) -> DataFrame:
    """Rows of a delivery in each part of the open intervals, with the least and greatest key there."""
    bounds = open_.select("q", F.col("slot").alias("s"), F.col("g"), "low", "high", "width")
    part = F.expr("cast((shiftright(key, 1) - shiftright(low, 1)) div width as int)")
    return (
        delivery.join(bounds, (F.col("slot") == F.col("s")) & F.col("group_value").eqNullSafe(F.col("g")))
        .where("key between low and high")
        .groupBy("q", "g", part.alias("part"))
        .agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most"))
    )


def add_up(counts: list[DataFrame]) -> DataFrame:
    """Counts of several deliveries as those of all: they add up, so days may be counted apart."""
    return (
        reduce(DataFrame.unionByName, counts)
        .groupBy("q", "g", "part")
        .agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    )


def exact_quantiles(
    deliveries: list[DataFrame], requests: DataFrame, parts: int = PARTS, sort_at: int = SORT_AT
) -> DataFrame:
    """The requested quantiles (request_id, slot, quantile) of the deliveries together: (request_id, group_value, n, value).

    Each delivery has the columns of once_per_group. Every request and group keeps an interval of
    sort keys and the rank it looks for, counted from the interval's low end; a pass counts the rows
    of each delivery below the interval's midpoints, adds the deliveries' counts up, and keeps the
    part which holds the rank, narrowed to the keys seen in it. A group is done when at most two
    neighbouring keys or sort_at rows are left, which are then ranked. The rank wanted of n values is
    the smallest whole number of at least quantile times n, and at least 1, so the error of the rank
    is 0, below any max_rank_error. Groups without values give no row; quantiles outside 0 to 1 none.
    """
    asked = requests.where("quantile between 0 and 1").select(F.col("request_id").alias("q"), "slot", F.col("quantile").cast("double").alias("quantile"))
    whole = [
        d.groupBy(F.col("slot").alias("q"), F.col("group_value").alias("g"), F.lit(0).alias("part")).agg(
            F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most")
        )
        for d in deliveries
    ]
    state = materialize(
        add_up(whole)
        .withColumnRenamed("q", "slot")
        .join(asked, "slot")
        .select(
            "q",
            "slot",
            "g",
            F.col("n").alias("total"),
            F.col("least").alias("low"),
            F.col("most").alias("high"),
            F.greatest(F.ceil(F.col("quantile") * F.col("n") - 1e-9), F.lit(1)).alias("rank"),
            F.col("n").alias("inside"),
        ),
        "intervals",
    )
    done = []
    while True:
        is_open = (_half("low") < _half("high")) & (F.col("inside") > sort_at)
        done.append(state.where(~is_open))
        open_ = state.where(is_open).withColumn("width", F.expr(f"(shiftright(high, 1) - shiftright(low, 1)) div {parts} + 1"))
        if open_.isEmpty():
            break
        found = add_up([_counts(d, open_) for d in deliveries])
        per = found.groupBy("q", "g").agg(F.array_sort(F.collect_list(F.struct("part", "n", "least", "most"))).alias("parts"))
        before = F.expr("transform(parts, (p, i) -> aggregate(slice(parts, 1, i), 0L, (a, x) -> a + x.n))")
        state = materialize(
            open_.alias("o")
            .join(per.alias("p"), (F.col("o.q") == F.col("p.q")) & F.col("o.g").eqNullSafe(F.col("p.g")))
            .select("o.q", "o.slot", "o.g", "total", "rank", F.posexplode("parts").alias("i", "part"), before.alias("before"))
            .withColumn("below", F.expr("before[i]"))
            .where("below < rank and rank <= below + part.n")
            .select(
                "q",
                "slot",
                "g",
                "total",
                F.col("part.least").alias("low"),
                F.col("part.most").alias("high"),
                (F.col("rank") - F.col("below")).alias("rank"),
                F.col("part.n").alias("inside"),
            ),
            "intervals",
        )
    ends = reduce(DataFrame.unionByName, done).select("q", F.col("slot").alias("s"), "g", "total", "low", "high", "rank")
    near = reduce(DataFrame.unionByName, deliveries).join(
        ends, (F.col("slot") == F.col("s")) & F.col("group_value").eqNullSafe(F.col("g"))
    ).where("key between low and high")
    # Ties are counted first, so what is ranked per group are at most sort_at different keys.
    ties = near.groupBy("q", "g", "total", "rank", "key").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    ranked = ties.groupBy("q", "g", "total", "rank").agg(F.array_sort(F.collect_list(F.struct("key", "n", "value"))).alias("t"))
    upto = "transform(t, (x, i) -> struct(aggregate(slice(t, 1, i + 1), 0L, (a, y) -> a + y.n) as upto, x.value as value))"
    return ranked.select(
        F.col("q").alias("request_id"),
        F.col("g").alias("group_value"),
        F.col("total").alias("n"),
        F.expr(f"filter({upto}, x -> x.upto >= rank)[0].value").alias("value"),
    )


def requested_quantiles(
    frames: list[DataFrame],
    requests: DataFrame,
    id_col: str = "read_id",
    groups: dict[str, Column] | None = None,
) -> DataFrame:
    """The rows of requests answered over the frames together: with n, value and the rank error reached, 0.

    Each frame is a delivery, such as a day, and is counted on its own. Null groups are groups of
    their own. Requests for unknown fields or groupings give no rows, nor do empty tables. Columns
    not asked for aren't read, so extra ones may have any name.
    """
    groups = groups or {
        "class": F.col("class"),
        "run_name": F.col("run_name"),
        "acquired_day": F.date_format("acquired_at", "yyyy-MM-dd"),
        "all": F.lit("all"),
    }
    slots = slots_of(requests)
    values = reduce(
        DataFrame.unionByName,
        [requested_values(f, slots, id_col, groups).withColumn("delivery", F.lit(i)) for i, f in enumerate(frames)],
    )
    once = materialize(once_per_group(values), "values")
    deliveries = [once.where(F.col("delivery") == i) for i in range(len(frames))]
    slot = reduce(
        lambda c, s: c.when(F.col("field").eqNullSafe(F.lit(s[1])) & F.col("group_field").eqNullSafe(F.lit(s[2])), s[0]),
        slots,
        F.when(F.lit(False), -1),
    )
    rows = requests.withColumn("slot", slot)
    return rows.join(exact_quantiles(deliveries, rows), "request_id").select(
        "request_id",
        "field",
        "group_field",
        "group_value",
        "quantile",
        "n",
        "value",
        F.lit(0.0).alias("rank_error"),
        "max_rank_error",
    )
