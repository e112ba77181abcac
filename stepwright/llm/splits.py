"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import file_key, run_key
from ..runtime import discard, materialize, ship
from .mixing import uniform


def connected(links: DataFrame) -> DataFrame:
    """Components of a graph of records and keys: (entry, group), the smallest entry of each component.

    links has one row (entry, key) for each record and each key it has. A key's label is the least
    of its records' labels and a record's label the least of its keys', taken in turn, with jumps
    along the labels, until nothing changes. Both steps are aggregations with partial sums, so a key
    that a third of all records share is one label, not pairs.
    """
    links = materialize(links.where("entry is not null and key is not null").distinct(), "links")
    label = materialize(links.groupBy("entry").agg(F.min("entry").alias("group")), "labels")
    while True:
        keys = links.join(label, "entry").groupBy("key").agg(F.min("group").alias("group"))
        near = links.join(keys, "key").groupBy("entry").agg(F.min("group").alias("near"))
        # A label is itself a record: its own label may be smaller already.
        jump = near.select(F.col("entry").alias("near"), F.col("near").alias("far"))
        new = materialize(
            label.join(near, "entry")
            .join(jump, "near", "left")
            .select("entry", F.least("group", "near", "far").alias("group"), F.col("group").alias("old")),
            "labels",
        )
        still = new.where("group <> old").isEmpty()
        discard(label)
        label = new.select("entry", "group")
        if still:
            discard(links)
            return label


def manifest_links(entries: DataFrame, reads: DataFrame | None) -> DataFrame:
    """What ties manifest entries: their run, their signal file, and runs that list the same read.

    Runs which no entry names tie nothing, nor do null or blank names, paths and reads.
    """
    runs = entries.select(F.col("entry_id").alias("entry"), run_key(F.col("run_name")).alias("run")).where("run is not null")
    files = entries.select(F.col("entry_id").alias("entry"), F.concat(F.lit("file "), file_key(F.col("file_path"))).alias("key"))
    by_run = runs.select("entry", F.concat(F.lit("run "), F.col("run")).alias("key"))
    links = by_run.unionByName(files.where("key is not null"))
    if reads is None:
        return links
    # One record per run stands for all of them: they are tied by the run already.
    first = runs.groupBy("run").agg(F.min("entry").alias("entry"))
    listed = reads.select("read_id", run_key(F.col("run_name")).alias("run")).where("read_id is not null").distinct()
    shared = listed.join(first, "run").select("entry", F.concat(F.lit("read "), F.col("read_id")).alias("key"))
    several = shared.groupBy("key").agg(F.min("entry").alias("a"), F.max("entry").alias("b")).where("a < b").select("key")
    return links.unionByName(shared.join(several, "key", "left_semi").select("entry", "key"))


def _deviation(have: np.ndarray, want: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * (have - want) ** 2).sum())


def _anneal(block: pd.DataFrame, shares: np.ndarray, rounds: int, heat: float) -> pd.DataFrame:
    """One block of components of one chain: moves and exchanges at falling temperature.

    block has a row per component and label: chain, group, split, label, n; and, for the labels of the
    whole table, the gap that this block is to close: want, a list with a number per split.
    """
    rng = np.random.default_rng(int(block["seed"].iloc[0]) & 0x7FFFFFFF)
    groups, at = np.unique(block["group"].to_numpy(), return_inverse=True)
    labels, lab = np.unique(block["label"].to_numpy(), return_inverse=True)
    size = np.zeros((len(groups), len(labels)))
    np.add.at(size, (at, lab), block["n"].to_numpy(float))
    split = np.zeros(len(groups), int)
    split[at] = block["split"].to_numpy(int)
    want = np.zeros((len(labels), len(shares)))
    want[lab] = np.array(block["want"].tolist())
    weight = 1.0 / np.maximum(size.sum(0), 1.0)[:, None]
    have = np.zeros_like(want)
    np.add.at(have.T, split, size)
    # The sizes are one more label, which all records have.
    size, want = np.c_[size, size.sum(1)], np.r_[want, want.sum(0)[None]]
    have = np.r_[have, have.sum(0)[None]]
    weight = np.r_[weight, [[4.0 / max(size[:, -1].sum(), 1.0)]]]
    cost = _deviation(have, want, weight)
    best, best_cost = split.copy(), cost
    for step in range(rounds):
        t = heat * max(best_cost, 1e-9) * (1 - step / rounds) ** 2
        i = int(rng.integers(len(groups)))
        if step % 2 or len(groups) < 2:  # move one component
            to = int(rng.integers(len(shares)))
            change = [(i, split[i], to)]
        else:  # exchange two components
            j = int(rng.integers(len(groups)))
            change = [(i, split[i], split[j]), (j, split[j], split[i])]
        new = have
        if any(a != b for _, a, b in change):
            new = have.copy()
            for k, a, b in change:
                new[:, a] -= size[k]
                new[:, b] += size[k]
            c = _deviation(new, want, weight)
            if c < cost or rng.random() < np.exp(-(c - cost) / max(t, 1e-12)):
                cost, have = c, new
                for k, _, b in change:
                    split[k] = b
                if cost < best_cost:
                    best, best_cost = split.copy(), cost
    return pd.DataFrame({"chain": block["chain"].iloc[0], "group": groups, "split": best})


def _annealer(shares: np.ndarray, steps: int, heat: float):
    return lambda block: _anneal(block, shares, steps, heat)


def assign_splits(
    members: DataFrame,
    targets: DataFrame,
    label: Column | None = None,
    chains: int = 4,
    rounds: int = 2,
    block_size: int = 400,
    steps: int = 1500,
    seed: int = 11,
) -> tuple[DataFrame, DataFrame]:
    """Give each group of members (entry, group, label) one of the splits of targets (split, target_share).

    Every chain starts from an assignment by hash. In each round the components of a chain are dealt
    to new random blocks of about block_size; a block anneals, by moves and exchanges of components,
    towards its part of what each split still lacks of each label and of all records. All blocks of
    all chains run in parallel as groups of one Spark job, and a block is bounded however large the
    table is. After the last round the state (of any round and chain, the hash included) with the
    least deviation is kept. Returns (group, split) and the costs (chain, round, cost).

    Shares are taken relative to their sum; rows without share or with a share of 0 or less get
    nothing. Without such rows no record gets a split and the results are empty.
    """
    rows = [(r[0], float(r[1])) for r in targets.select("split", "target_share").collect() if r[1] and r[1] > 0]
    rows.sort(key=lambda r: (r[0] is None, r[0]))
    total = sum(s for _, s in rows)
    names, shares = [n for n, _ in rows], np.array([s / total for _, s in rows])
    sizes = materialize(members.groupBy("group", F.coalesce("label", F.lit("")).alias("label")).agg(F.count("*").alias("n")), "components")
    spark = members.sparkSession
    ship(spark)
    if not names:
        nothing = sizes.select("group", F.lit(None).cast("string").alias("split")).limit(0)
        return nothing, spark.createDataFrame([], "chain int, round int, cost double")
    ends = np.cumsum(shares)
    draw = uniform("group", "chain", seed=seed)
    first = F.lit(len(names) - 1)
    for i in reversed(range(len(names) - 1)):
        first = F.when(draw < F.lit(float(ends[i])), F.lit(i)).otherwise(first)
    all_chains = F.explode(F.array(*[F.lit(c) for c in range(chains)])).alias("chain")
    state = sizes.select("group").distinct().select("group", all_chains).withColumn("split", first)
    state = materialize(state, "assigned")
    n_groups = sizes.select("group").distinct().count()
    blocks = max(1, round(n_groups / block_size))
    totals = sizes.groupBy("label").agg(F.sum("n").alias("total"))
    kept, costs = [state], []
    share_list = [float(s) for s in shares]
    for r in range(rounds):
        placed = state.join(sizes, "group")
        dealt = placed.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + r), "chain", "group"), F.lit(blocks)).cast("int"))
        # What the block has of a label, and its part of what the splits lack of it beyond their share.
        have = dealt.groupBy("chain", "label").agg(*[F.sum(F.when(F.col("split") == i, F.col("n")).otherwise(0)).alias(f"h{i}") for i in range(len(names))])
        lack = have.join(totals, "label").select(
            "chain", "label", *[((F.lit(s) * F.col("total") - F.col(f"h{i}")) / blocks).alias(f"l{i}") for i, s in enumerate(share_list)]
        )
        local = dealt.groupBy("chain", "block", "label").agg(*[F.sum(F.when(F.col("split") == i, F.col("n")).otherwise(0)).alias(f"b{i}") for i in range(len(names))])
        goal = local.join(lack, ["chain", "label"]).select(
            "chain", "block", "label", F.array(*[(F.col(f"b{i}") + F.col(f"l{i}")).cast("double") for i in range(len(names))]).alias("want")
        )
        work = dealt.join(goal, ["chain", "block", "label"]).withColumn("seed", F.xxhash64(F.lit(seed), F.lit(r), "chain", "block"))
        # A small shuffle would be merged into one task, but the work is in the blocks: an explicit number stays.
        work = work.repartition(min(chains * blocks, 4 * spark.sparkContext.defaultParallelism), "chain", "block")

        state = materialize(
            work.groupBy("chain", "block").applyInPandas(_annealer(shares, steps, 0.2 / (1 + r)), "chain int, group long, split int"),
            "assigned",
        )
        kept.append(state)
    # The deviation of each state, from its sums per label.
    for r, s in enumerate(kept):
        placed = s.join(sizes, "group").groupBy("chain", "label").agg(
            *[F.sum(F.when(F.col("split") == i, F.col("n")).otherwise(0)).alias(f"h{i}") for i in range(len(names))]
        )
        off = placed.join(totals, "label")
        gap = sum((F.pow(F.col(f"h{i}") - F.lit(x) * F.col("total"), 2) for i, x in enumerate(share_list)), F.lit(0.0))
        sums = [F.sum(f"h{i}").alias(f"h{i}") for i in range(len(names))]
        by_chain = off.withColumn("gap", gap / F.col("total")).groupBy("chain").agg(F.sum("gap").alias("labels"), F.sum("total").alias("total"), *sums)
        whole = sum((F.pow(F.col(f"h{i}") - F.lit(x) * F.col("total"), 2) for i, x in enumerate(share_list)), F.lit(0.0))
        costs.append(by_chain.select("chain", F.lit(r).alias("round"), (F.col("labels") + 4.0 * whole / F.col("total")).alias("cost")))
    report = costs[0]
    for c in costs[1:]:
        report = report.unionByName(c)
    report = materialize(report, "costs")
    won = report.orderBy("cost", "round", "chain").first()
    if won is None:
        return state.select("group", F.lit(None).cast("string").alias("split")).limit(0), report
    names_col = F.array(*[F.lit(n) for n in names])
    best = kept[won["round"]].where(F.col("chain") == won["chain"]).select("group", F.element_at(names_col, F.col("split") + 1).alias("split"))
    return best, report


def split_report(members: DataFrame, targets: DataFrame) -> DataFrame:
    """Shares that the splits of members (entry_id, class, split) reach, per class and over all (class null and overall):

    (overall, class, split, target_share, n, reached_share). Every split with a share has a row for every class.
    """
    each = members.select(F.lit(False).alias("overall"), "class", "split").unionByName(members.select(F.lit(True).alias("overall"), F.lit(None).cast("string").alias("class"), "split"))
    counted = each.groupBy("overall", "class", "split").agg(F.count("*").alias("n"))
    totals = each.groupBy("overall", "class").agg(F.count("*").alias("total"))
    wanted = targets.where("target_share > 0").groupBy("split").agg(F.sum("target_share").alias("share"))
    wanted = wanted.crossJoin(F.broadcast(wanted.agg(F.sum("share").alias("all"))))  # targets is a small table
    grid = totals.crossJoin(F.broadcast(wanted.select("split", (F.col("share") / F.col("all")).alias("target_share"))))
    same = [F.col(f"g.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("overall", "class", "split")]
    joined = grid.alias("g").join(counted.alias("c"), same[0] & same[1] & same[2], "left")
    n = F.coalesce("c.n", F.lit(0))
    return joined.select("g.overall", "g.class", "g.split", "g.target_share", n.alias("n"), (n / F.col("g.total")).alias("reached_share"))


def split_manifest(entries: DataFrame, reads: DataFrame | None, targets: DataFrame, **options) -> DataFrame:
    """Each manifest entry with its group and split: (entry_id, class, group_id, group_size, split).

    Entries share a group if they name the same run or signal file, however written, or if a read is
    listed under the runs of both; this carries over. group_id is the group's smallest entry_id. The
    labels which the splits share out evenly are the classes; a null class is a label as well.
    Entries without entry_id are left out; an entry_id that occurs twice is one entry. A group that
    holds more than a split's share stays whole, so the shares are then met as far as it allows.
    """
    entries = entries.where("entry_id is not null")
    tied = connected(manifest_links(entries, reads))
    each = entries.groupBy("entry_id").agg(F.min("class").alias("label"))
    members = materialize(
        each.join(tied, each.entry_id == tied.entry, "left").select("entry_id", F.coalesce("group", "entry_id").alias("group"), "label"),
        "members",
    )
    split, _ = assign_splits(members.withColumnRenamed("entry_id", "entry"), targets, **options)
    count = members.groupBy("group").agg(F.count("*").alias("group_size"))
    return (
        members.join(count, "group")
        .join(split, "group", "left")
        .select("entry_id", F.col("label").alias("class"), F.col("group").alias("group_id"), "group_size", "split")
    )
