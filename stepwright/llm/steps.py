"""Collapsing runs of near-identical consecutive steps."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.ranks import sum_before
from ..runtime import materialize, ship

#: Samples of a read handled together: a bound on what one row of the agglomeration holds.
CHUNK = 1 << 16
#: Up to so many values percentile_approx with accuracy 10,000 keeps every one (it merges none below 5,000) and is exact.
FEW = 4096
RUN = "array<struct<s:int,e:int,n:int,first:double,last:double,level:double,samples:bigint>>"


def agglomerate(s, e, mean, noise: float, max_gap: int | None, linkage: str = "seam") -> list[tuple[int, int]]:
    """First and last index of each run: the most similar neighbours merge first, until none is left that may.

    Runs are a linked list (the far end of each is known at either end) and the seams between them a
    priority queue. With linkage "seam" its keys are the differences of the two steps that meet there,
    with "level" those of the levels of the two runs, their means by length, taken anew at both ends of
    a run when it has merged; a key that is out of date is dropped when its turn comes.
    """
    n = len(mean)
    end_of, start_of = list(range(n)), list(range(n))
    step = np.abs(np.diff(mean))
    apart = np.zeros(max(n - 1, 0), bool) if max_gap is None else (s[1:] - e[:-1]) > max_gap
    # No merge brings a seam's steps nearer, but a run's level may come nearer to its neighbour's.
    seams = [(step[i], i) for i in np.flatnonzero(~apart & (step <= noise)).tolist()]
    heapq.heapify(seams)
    level, weight = list(map(float, mean)), np.maximum(e - s, 1).astype(float).tolist()
    gone = bytearray(n)
    while seams:
        key, i = heapq.heappop(seams)
        a, b = start_of[i], end_of[i + 1]
        if linkage == "level":
            if gone[i] or key != abs(level[i + 1] - level[a]):
                continue
            gone[i] = 1
            total = weight[a] + weight[i + 1]
            level[a] = (level[a] * weight[a] + level[i + 1] * weight[i + 1]) / total
            weight[a] = total
        end_of[a], start_of[b] = b, a
        if linkage == "level":
            for at, left, right in ((a - 1, start_of[a - 1] if a else 0, a), (b, a, b + 1)):
                if 0 <= at < n - 1 and not apart[at]:
                    new = abs(level[right] - level[left])
                    if new <= noise:
                        heapq.heappush(seams, (new, at))
    out, i = [], 0
    while i < n:
        out.append((i, end_of[i]))
        i = end_of[i] + 1
    return out


def _runs_of(steps: Column, noise: Column, max_gap: int | None, linkage: str) -> Column:
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lists, noises in batches:
            flat = lists.flatten()
            s, e, m = (np.asarray(flat.field(k)) for k in ("s", "e", "mean"))
            ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
            limit = np.nan_to_num(np.asarray(noises.cast(pa.float64()), dtype=float), nan=0.0)
            length = (e - s).astype(float)
            rows, offsets = [], [0]
            for k in range(len(ends) - 1):
                a, b = ends[k], ends[k + 1]
                rows.extend((a + i, a + j) for i, j in agglomerate(s[a:b], e[a:b], m[a:b], limit[k], max_gap, linkage))
                offsets.append(len(rows))
            i, j = (np.array(rows, dtype=np.int64).reshape(-1, 2)).T
            total = np.r_[0.0, np.cumsum(length)]
            samples = total[j + 1] - total[i]
            level = np.add.reduceat(m * length, i) / np.where(samples > 0, samples, 1) if len(i) else np.zeros(0)
            level = np.where((samples > 0) & (j > i), level, m[i] if len(i) else 0.0)
            fields = {
                "s": pa.array(s[i], pa.int32()),
                "e": pa.array(e[j], pa.int32()),
                "n": pa.array(j - i + 1, pa.int32()),
                "first": pa.array(m[i], pa.float64()),
                "last": pa.array(m[j], pa.float64()),
                "level": pa.array(level, pa.float64()),
                "samples": pa.array(samples.astype(np.int64), pa.int64()),
            }
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))

    return F.arrow_udf(run, RUN)(steps, noise)


def _many(steps: DataFrame) -> DataFrame:
    """The reads with more than FEW rows with std above 0; repeated rows count, so none is missed."""
    noisy = steps.where("read_id is not null and s is not null and std > 0 and not isnan(std)")
    return materialize(noisy.groupBy("read_id").agg(F.count("*").alias("rows")).where(F.col("rows") > FEW).select("read_id"), "many")


def _medians(clean: DataFrame, many: DataFrame) -> DataFrame:
    """The exact lower median of the std above 0 of each read in many, by counts: (read_id, median)."""
    counts = materialize(clean.where("std > 0").join(many, "read_id").groupBy("read_id", "std").agg(F.count("*").alias("n")), "counts")
    total = counts.groupBy("read_id").agg(F.sum("n").alias("total"))
    rank = F.ceil(F.col("total") / 2)
    holds = (F.col("before") < rank) & (rank <= F.col("before") + F.col("n"))
    return sum_before(counts, ["read_id"], "std", "n", written=True).join(total, "read_id").where(holds).select("read_id", F.col("std").alias("median"))


def collapse_steps(
    steps: DataFrame,
    factor: float = 1.0,
    max_gap: int | None = None,
    chunk: int = CHUNK,
    linkage: str = "seam",
) -> DataFrame:
    """Collapse stretches at one level: (read_id, run_start, run_end, n_steps, duration, samples, level).

    Steps of a read follow each other by s. Neighbours belong to one run if their means differ by no
    more than factor times the read's noise, the exact lower median of its steps' std that are above 0,
    whatever their number; a read without such a std has no noise, and only equal means merge. With max_gap, neighbours more than so
    many samples apart stay apart. A row that is there again in full is one step. Steps whose mean is
    missing (null or NaN) are passed over: their neighbours follow each other. Ties in s are ordered
    by e, then mean. Rows without read_id or s are left out. duration runs from the first sample to
    the last, samples counts those in steps, level is their mean. With linkage "level" neighbours are
    compared by the levels of their runs, taken anew after each merge, so a slow drift isn't one run.

    A read is cut into chunks of samples, which are agglomerated in parallel; runs that touch a
    chunk's border are then put together from one small row each, so that no read, however long, is
    one task's work.
    """
    ship(steps.sparkSession)
    clean = (
        steps.select("read_id", "s", "e", F.nanvl("mean", F.lit(None)).alias("mean"), F.nanvl("std", F.lit(None)).alias("std"))
        .where("read_id is not null and s is not null")
        .withColumn("chunk", F.floor(F.col("s") / chunk).cast("int"))
        # One shuffle serves the removal of repeated rows, the lists per chunk and, by its reuse, the noise.
        .repartition("read_id", "chunk")
        .distinct()
    )
    per_read = clean.groupBy("read_id").agg(
        F.percentile_approx(F.when(F.col("std") > 0, F.col("std")), 0.5, 10000).alias("noise"),
        (F.min("chunk") == F.max("chunk")).alias("single"),
    )
    many = _many(steps)
    if not many.isEmpty():
        exact = _medians(clean, many)
        per_read = per_read.join(exact, "read_id", "left").select("read_id", F.coalesce("median", "noise").alias("noise"), "single")
    # Steps without mean leave inside the aggregate: a filter would go below the shuffle and make it another one.
    step = F.when(F.col("mean").isNotNull(), F.struct("s", F.coalesce("e", "s").alias("e"), "mean"))
    lists = clean.groupBy("read_id", "chunk").agg(F.array_sort(F.collect_list(step)).alias("steps")).where("size(steps) > 0")
    noise = F.coalesce(F.col("noise") * factor, F.lit(0.0))
    runs = materialize(
        lists.join(per_read, "read_id")
        .select("read_id", "chunk", "single", "noise", F.posexplode(_runs_of(F.col("steps"), noise, max_gap, linkage)).alias("at", "r"))
        .select("read_id", "chunk", "single", "noise", "at", "r.*"),
        "runs",
    )
    inner = ["read_id", F.col("s").alias("run_start"), F.col("e").alias("run_end"), F.col("n").alias("n_steps"), "samples", "level"]
    ends = runs.where("not single").groupBy("read_id", "chunk").agg(F.max("at").alias("top"))
    marked = runs.where("not single").join(ends, ["read_id", "chunk"])
    border = marked.where("at = 0 or at = top")
    order = W.partitionBy("read_id").orderBy("chunk", "at")
    near = F.abs(F.col("first" if linkage == "seam" else "level") - F.lag("last" if linkage == "seam" else "level").over(order)) <= noise
    if max_gap is not None:
        near = near & (F.col("s") - F.lag("e").over(order) <= max_gap)
    # Two border runs of one chunk were compared already, or stand apart.
    apart = ~F.coalesce(near & (F.lag("chunk").over(order) < F.col("chunk")), F.lit(False))
    chained = border.withColumn("apart", apart.cast("int")).withColumn("chain", F.sum("apart").over(order))
    weight = F.sum("samples")
    joined = chained.groupBy("read_id", "chain").agg(
        F.min_by("s", F.struct("chunk", "at")).alias("run_start"),
        F.max_by("e", F.struct("chunk", "at")).alias("run_end"),
        F.sum("n").cast("int").alias("n_steps"),
        weight.alias("samples"),
        F.coalesce(F.try_divide(F.sum(F.col("level") * F.col("samples")), weight), F.min("level")).alias("level"),
    )
    return (
        runs.where("single")
        .select(*inner)
        .unionByName(marked.where("at > 0 and at < top").select(*inner))
        .unionByName(joined.drop("chain"))
        .withColumn("duration", F.col("run_end") - F.col("run_start"))
    )


def step_features(runs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The step features of each read from its collapsed steps: n_steps, mean_step_len, max_step_height.

    Heights are the differences of neighbouring levels; they are taken within chunks of samples, and
    between chunks from one row per chunk. A read with one step has no height (null).
    """
    parts = runs.withColumn("part", F.floor(F.col("run_start") / chunk))
    inside = W.partitionBy("read_id", "part").orderBy("run_start", "run_end")
    chunks = (
        parts.withColumn("height", F.abs(F.col("level") - F.lag("level").over(inside)))
        .groupBy("read_id", "part")
        .agg(
            F.count("*").alias("n"),
            F.sum("samples").alias("samples"),
            F.max("height").alias("height"),
            F.min_by("level", F.struct("run_start", "run_end")).alias("first"),
            F.max_by("level", F.struct("run_start", "run_end")).alias("last"),
        )
    )
    across = F.abs(F.col("first") - F.lag("last").over(W.partitionBy("read_id").orderBy("part")))
    return (
        chunks.withColumn("across", across)
        .groupBy("read_id")
        .agg(
            F.sum("n").alias("n_steps"),
            (F.sum("samples") / F.sum("n")).alias("mean_step_len"),
            F.greatest(F.max("height"), F.max("across")).alias("max_step_height"),
        )
    )
