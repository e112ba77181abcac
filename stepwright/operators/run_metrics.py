"""Counters, ratios and yields per run and reference, from reads, alignments, regions and the sequencing summary.

Tables: reads (run, read_id, basecalled), alignments (run, read_id, reference, flag, pos, end, strand),
regions (run, read_id, reference, ref_start, ref_end) and summary (run, read_id, channel, end_reason).
Ids are counted in two steps, first once per run, reference and id, so that no task holds the ids of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import group_quantiles

# Reasons for which the device ended a read before it was through.
REJECTED = ("mux_change", "signal_negative")


def safe_number(value: Column) -> Column:
    """A text as a number; what is none counts as 0."""
    return F.coalesce(F.nanvl(value.try_cast("double"), F.lit(None)), F.lit(0.0))


def mapped(alignments: DataFrame) -> DataFrame:
    """Without the unmapped ones, whose flag has the bit 4."""
    return alignments.where(F.col("flag").bitwiseAND(4) == 0)


def mapped_per_reference(alignments: DataFrame) -> DataFrame:
    """Mapped alignments per run and reference."""
    return mapped(alignments).groupBy("run", "reference").agg(F.count("*").alias("mapped_to_ref_idxstats"))


def active_channels(summary: DataFrame) -> DataFrame:
    """Different channels per run; missing ones don't count. Few, whatever the number of reads."""
    once = summary.where("channel is not null").select("run", F.col("channel").cast("int").alias("channel")).distinct()
    return once.groupBy("run").agg(F.count("*").alias("active_channels"))


def rejected_ids(summary: DataFrame) -> DataFrame:
    """The reads of each run that were rejected, each once."""
    return summary.where(F.col("end_reason").isin(*REJECTED) & F.col("read_id").isNotNull()).select("run", "read_id").distinct()


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def metric_documents(reads: DataFrame, alignments: DataFrame, regions: DataFrame, summary: DataFrame, start_before: int = 30, end_after: int = 110) -> DataFrame:
    """One row of counters and ratios for each run and reference that has an alignment.

    Ratios are 0 where nothing was rejected or aligned; counts of runs without reads, regions or
    summary are 0, and their channels null.
    """
    per_run = reads.groupBy("run").agg(F.count("*").alias("pod5_reads"), F.count_if("basecalled").alias("basecalled_reads"))
    on = mapped(alignments)
    full = (F.col("pos") < start_before) & (F.col("end") > end_after)
    counts = on.groupBy("run", "reference").agg(F.count("*").alias("aligned_reads_to_ref"), F.count_if(full).alias("aligned_reads_to_ref_st30_en110"))
    inside = (F.col("ref_start") <= start_before) & (F.col("ref_end") >= end_after)
    plr = regions.groupBy("run", "reference").agg(F.count("*").alias("plr_unique_reads"), F.count_if(inside).alias("plr_unique_reads_full_alignment"))
    rejected = rejected_ids(summary)
    n_rejected = rejected.groupBy("run").agg(F.count("*").alias("rejected_reads_count"))
    marked = rejected.withColumn("hit", F.lit(1))
    ids = alignments.select("run", "reference", "read_id").distinct().join(marked, ["run", "read_id"], "left")
    shared = ids.groupBy("run", "reference").agg(F.count("*").alias("ids"), F.count("hit").alias("shared_aligned"))
    found = regions.select("run", "reference", "read_id").distinct().join(rejected, ["run", "read_id"], "left_semi")
    both = found.groupBy("run", "reference").agg(F.count("*").alias("shared_plr"))
    keys = ["run", "reference"]
    out = counts.join(per_run, "run", "left").join(plr, keys, "left").join(active_channels(summary), "run", "left")
    out = out.join(n_rejected, "run", "left").join(shared, keys, "left").join(both, keys, "left").join(mapped_per_reference(alignments), keys, "left")
    names = ["pod5_reads", "basecalled_reads", "plr_unique_reads", "plr_unique_reads_full_alignment", "rejected_reads_count", "shared_aligned", "shared_plr"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
    return out.select(
        *keys, "pod5_reads", "basecalled_reads", "aligned_reads_to_ref", "plr_unique_reads", "plr_unique_reads_full_alignment", "active_channels", "rejected_reads_count",
        _ratio(F.col("shared_aligned"), F.col("rejected_reads_count")).alias("ratio_rejected_reads_aligned_reads"),
        _ratio(F.col("shared_plr"), F.col("rejected_reads_count")).alias("ratio_rejected_reads_plr_unique_reads"),
        _ratio(F.col("shared_aligned"), F.col("ids")).alias("ratio_aligned_reads_rejected_reads"),
        "aligned_reads_to_ref_st30_en110", "mapped_to_ref_idxstats",
    )


def yields(documents: DataFrame) -> DataFrame:
    """documents with five yields, null where a number is missing or the whole is 0."""
    part = {
        "basecall_yield": ("basecalled_reads", "pod5_reads"),
        "alignment_yield": ("aligned_reads_to_ref", "pod5_reads"),
        "full_alignment_yield": ("aligned_reads_to_ref_st30_en110", "aligned_reads_to_ref"),
        "plr_fraction_of_aligned": ("plr_unique_reads", "aligned_reads_to_ref"),
        "plr_fraction_of_aligned_full": ("plr_unique_reads_full_alignment", "aligned_reads_to_ref_st30_en110"),
    }
    return documents.withColumns({k: F.try_divide(a, b) for k, (a, b) in part.items()})


def runs_wide(documents: DataFrame, references: list[str]) -> DataFrame:
    """One row per run: what holds for the run, and a column per reference for each of three measures, with their total.

    The references are given, so the columns are the same for all data; missing pairs are 0. The
    total counts full alignments a second time, as they have a column of their own.
    """
    measures = {"aligned_reads_to_ref": "aligned_reads_to_", "aligned_reads_to_ref_st30_en110": "aligned_reads_to_ref_st30_en110_", "plr_unique_reads": "plr_"}
    first = [F.max(c).alias(c) for c in ("pod5_reads", "basecalled_reads", "active_channels")]
    cells = [
        F.coalesce(F.sum(F.when(F.col("reference") == r, F.col(m))), F.lit(0)).alias(p + r) for m, p in measures.items() for r in references
    ]
    wide = documents.groupBy("run").agg(*first, *cells)
    like = [c for c in wide.columns if c.startswith("aligned_reads_to_")]
    return wide.withColumn("aligned_reads_total", sum((F.col(c) for c in like[1:]), F.col(like[0])) if like else F.lit(0).cast("long"))


def direction_ratios(documents: DataFrame, forward: str, reverse: str) -> DataFrame:
    """Per run the share of the forward control in both, for alignments, full alignments and regions; null where there are none."""
    measures = {"aligned": "aligned_reads_to_ref", "full": "aligned_reads_to_ref_st30_en110", "plr": "plr_unique_reads"}
    cells = [F.coalesce(F.sum(F.when(F.col("reference") == r, F.col(m))), F.lit(0)).alias(f"{k}_{s}") for k, m in measures.items() for s, r in (("a", forward), ("b", reverse))]
    wide = documents.groupBy("run").agg(*cells)
    return wide.select("run", *[F.try_divide(f"{k}_a", F.col(f"{k}_a") + F.col(f"{k}_b")).alias(f"{k}_ratio") for k in measures])


def rejected_fraction(documents: DataFrame) -> DataFrame:
    """documents' share of aligned reads that were rejected, 0 where none is aligned."""
    part = F.try_divide(F.col("ratio_rejected_reads_aligned_reads") * F.col("rejected_reads_count"), F.col("aligned_reads_to_ref"))
    return documents.select("run", "reference", F.coalesce(part, F.lit(0.0)).alias("frac_aligned_rejected"))


def median_per_reference(rows: DataFrame, value: str) -> DataFrame:
    """The median over runs of a value per reference; missing values don't count."""
    return group_quantiles(rows.select("reference", value), ["reference"], value, {f"median_{value}": 0.5})


def dataset_table(reads: DataFrame, funnel: DataFrame) -> DataFrame:
    """Basecalls, template alignments and valid regions per run that both tables know: (name, …, percentage as text).

    funnel: (run, filter, count) as the detector's summaries have it. A run that only one of the
    tables knows gets no row; missing_runs lists those.
    """
    base = reads.groupBy("run").agg(F.count_if("basecalled").alias("n_basecalls"))
    pick = lambda k: F.max(F.when(F.col("filter") == k, F.col("count")))
    by_run = funnel.groupBy("run").agg(F.coalesce(pick("Total Input Reads"), pick("Total Processed"), F.lit(0)).alias("n_aligned"), F.coalesce(pick("Valid Reads"), F.lit(0)).alias("n_valid"))
    share = F.coalesce(F.try_divide(F.col("n_valid") * 100.0, F.col("n_aligned")), F.lit(0.0))
    return base.join(by_run, "run").select(F.col("run").alias("name"), "n_basecalls", "n_aligned", "n_valid", F.format_string("%.2f", share).alias("valid_of_aligned"))


def missing_runs(a: DataFrame, b: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Runs that only one of two tables knows: (run, missing_in). Empty if they agree."""
    left, right = (t.select("run").where("run is not null").distinct() for t in (a, b))
    return left.join(right, "run", "left_anti").withColumn("missing_in", F.lit(names[1])).unionByName(right.join(left, "run", "left_anti").withColumn("missing_in", F.lit(names[0])))


def run_grid(runs: DataFrame, references: list[str]) -> DataFrame:
    """All runs with all references, of which there is a fixed list: what a run still lacks shows as a row without data."""
    return runs.select("run").distinct().select("run", F.explode(F.array(*[F.lit(r) for r in references])).alias("reference"))


def run_summary(documents: DataFrame, references: list[str]) -> DataFrame:
    """Basecalled, aligned and region counts of every run and reference, 0 where there are none."""
    rows = run_grid(documents, references).join(documents, ["run", "reference"], "left")
    per_run = documents.groupBy("run").agg(F.max("basecalled_reads").alias("n_basecalled"))
    return rows.join(per_run, "run").select("run", "reference", "n_basecalled", *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (("aligned_reads_to_ref", "n_aligned"), ("plr_unique_reads", "n_plr"))])


def first_alignments(alignments: DataFrame) -> DataFrame:
    """Each read's first alignment by position, and how many it has; ties go to the first reference, flag and end."""
    first = F.min(F.struct("pos", "reference", "flag", "end", "strand")).alias("f")
    return alignments.groupBy("run", "read_id").agg(first, F.count("*").alias("n_alignments")).select("run", "read_id", "f.*", "n_alignments")
