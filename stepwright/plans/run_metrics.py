"""Queries of run metrics, with their SQL.

The given tables stand for the runs' own: orders are reads with their channel and end reason,
lineitem are alignments, and those of at least 30 units the regions found.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import run_metrics as M
from ..runtime import table
from .reach import r6

REFERENCES = ["template", "threading", "revcomp"]


def _rounded(df):
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _reads(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("run"), F.col("o_custkey") % 8).alias("run"), F.col("o_orderkey").alias("read_id"), (F.col("o_orderstatus") != "P").alias("basecalled"))


def _summary(spark, d):
    o = table(spark, d, "orders")
    p = F.substring("o_orderpriority", 1, 1)
    reason = F.when(p == "1", "mux_change").when(p == "2", "signal_negative").otherwise("signal_positive")
    return o.select(F.concat(F.lit("run"), F.col("o_custkey") % 8).alias("run"), F.col("o_orderkey").alias("read_id"), (F.col("o_custkey") % 512).alias("channel"), reason.alias("end_reason"))


def _alignments(spark, d):
    i = table(spark, d, "lineitem")
    ref = F.when(F.col("l_returnflag") == "A", "template").when(F.col("l_returnflag") == "N", "threading").otherwise("revcomp")
    start = F.col("l_linenumber") * 5
    return i.select(
        F.concat(F.lit("run"), F.col("l_suppkey") % 8).alias("run"), F.col("l_orderkey").alias("read_id"), ref.alias("reference"),
        F.when(F.col("l_linenumber") == 7, 4).otherwise(0).alias("flag"), (start + 1).alias("pos"), (start + 3 * F.col("l_quantity").cast("int")).alias("end"),
        F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"), "l_quantity",
    )


def _regions(spark, d):
    return _alignments(spark, d).where("l_quantity >= 30 and flag = 0").select("run", "read_id", "reference", (F.col("pos") - 1).alias("ref_start"), F.col("end").alias("ref_end"))


def _documents(spark, d):
    return M.metric_documents(_reads(spark, d), _alignments(spark, d), _regions(spark, d), _summary(spark, d))


def _funnel(spark, d):
    a = M.mapped(_alignments(spark, d)).where("reference = 'template'")
    per = a.groupBy("run").agg(F.count("*").alias("Total Input Reads"), F.count_if(F.col("l_quantity") >= 30).alias("Valid Reads"))
    return per.unpivot("run", ["Total Input Reads", "Valid Reads"], "filter", "count")


def run_documents(spark, d):
    return _rounded(_documents(spark, d))


def run_yields(spark, d):
    return _rounded(M.yields(_documents(spark, d)).select("run", "reference", "basecall_yield", "alignment_yield", "full_alignment_yield", "plr_fraction_of_aligned", "plr_fraction_of_aligned_full"))


def run_wide(spark, d):
    return M.runs_wide(_documents(spark, d), REFERENCES)


def run_directions(spark, d):
    return _rounded(M.direction_ratios(_documents(spark, d), "threading", "revcomp"))


def run_rejected_by_reference(spark, d):
    return _rounded(M.median_per_reference(M.rejected_fraction(_documents(spark, d)), "frac_aligned_rejected"))


def run_regions_by_reference(spark, d):
    return _rounded(M.median_per_reference(M.yields(_documents(spark, d)), "plr_fraction_of_aligned"))


def run_dataset_table(spark, d):
    return M.dataset_table(_reads(spark, d), _funnel(spark, d))


def run_missing(spark, d):
    """Runs of suppliers' alignments that no sequencing summary knows, and the other way round."""
    few = _summary(spark, d).where("run <> 'run3'")
    return M.missing_runs(few, _alignments(spark, d).where("run <> 'run5'"), ("summary", "alignments"))


def run_summary(spark, d):
    return M.run_summary(_documents(spark, d).where("reference <> 'revcomp' or run <> 'run2'"), REFERENCES)


def run_first_alignments(spark, d):
    return M.first_alignments(M.mapped(_alignments(spark, d)))


def run_mapped_ids(spark, d):
    """Ids of mapped reads that lie in the span before 30 and after 110, each once (the list a filter by ids reads)."""
    return M.mapped(_alignments(spark, d)).where("pos < 30 and end > 110").select("run", "reference", "read_id").distinct()


def run_reads_of_ids(spark, d):
    """Reads restricted to an id list: those rejected, with their channel."""
    return _summary(spark, d).join(M.rejected_ids(_summary(spark, d)), ["run", "read_id"], "left_semi").select("run", "read_id", "channel")


QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("run_") and callable(f)}

_W = """with reads as (select 'run' || (o_custkey % 8) as run, o_orderkey as read_id, o_orderstatus <> 'P' as basecalled, cast(o_custkey % 512 as bigint) as channel,
    case substr(o_orderpriority, 1, 1) when '1' then 'mux_change' when '2' then 'signal_negative' else 'signal_positive' end as end_reason from orders),
  al as (select 'run' || (l_suppkey % 8) as run, l_orderkey as read_id, case l_returnflag when 'A' then 'template' when 'N' then 'threading' else 'revcomp' end as reference,
    case when l_linenumber = 7 then 4 else 0 end as flag, l_linenumber * 5 + 1 as pos, l_linenumber * 5 + 3 * cast(l_quantity as integer) as "end", case when l_linestatus = 'O' then '+' else '-' end as strand, l_quantity from lineitem),
  plr as (select run, read_id, reference, pos - 1 as ref_start, "end" as ref_end from al where l_quantity >= 30 and flag = 0),
  rej as (select distinct run, read_id from reads where end_reason in ('mux_change', 'signal_negative')),
  per_run as (select run, count(*) as pod5_reads, count(*) filter (basecalled) as basecalled_reads, count(distinct channel) as active_channels from reads group by run),
  doc as (select a.run, a.reference, pod5_reads, basecalled_reads, a.n as aligned_reads_to_ref, coalesce(p.n, 0) as plr_unique_reads, coalesce(p.f, 0) as plr_unique_reads_full_alignment, active_channels,
      coalesce(r.n, 0) as rejected_reads_count, coalesce(s.n / nullif(cast(r.n as double), 0), 0) as ratio_rejected_reads_aligned_reads, coalesce(q.n / nullif(cast(r.n as double), 0), 0) as ratio_rejected_reads_plr_unique_reads,
      coalesce(s.n / nullif(cast(s.ids as double), 0), 0) as ratio_aligned_reads_rejected_reads, a.f as aligned_reads_to_ref_st30_en110, a.n as mapped_to_ref_idxstats
    from (select run, reference, count(*) as n, count(*) filter (pos < 30 and "end" > 110) as f from al where flag & 4 = 0 group by all) a
    left join per_run using (run)
    left join (select run, reference, count(*) as n, count(*) filter (ref_start <= 30 and ref_end >= 110) as f from plr group by all) p on p.run = a.run and p.reference = a.reference
    left join (select run, count(*) as n from rej group by run) r on r.run = a.run
    left join (select run, reference, count(*) filter (hit) as n, count(*) as ids from (select distinct run, reference, read_id, (run, read_id) in (select (run, read_id) from rej) as hit from al) group by all) s on s.run = a.run and s.reference = a.reference
    left join (select run, reference, count(*) as n from (select distinct run, reference, read_id from plr where (run, read_id) in (select (run, read_id) from rej)) group by all) q on q.run = a.run and q.reference = a.reference)
"""
_RATIOS = ("ratio_rejected_reads_aligned_reads", "ratio_rejected_reads_plr_unique_reads", "ratio_aligned_reads_rejected_reads")


def _part(a: str, b: str, name: str) -> str:
    return f"round({a} / nullif(cast({b} as double), 0) + 1e-8, 6) as {name}"


def _cell(m: str, r: str, name: str) -> str:
    return f"cast(coalesce(sum({m}) filter (reference = '{r}'), 0) as bigint) as {name}"


_WIDE = [_cell(m, r, p + r) for m, p in (("aligned_reads_to_ref", "aligned_reads_to_"), ("aligned_reads_to_ref_st30_en110", "aligned_reads_to_ref_st30_en110_"), ("plr_unique_reads", "plr_")) for r in REFERENCES]

SQL = {
    "run_documents": _W + "select * replace (" + ", ".join(f"round({c} + 1e-8, 6) as {c}" for c in _RATIOS) + ") from doc",
    "run_yields": _W + "select run, reference, " + ", ".join([_part("basecalled_reads", "pod5_reads", "basecall_yield"), _part("aligned_reads_to_ref", "pod5_reads", "alignment_yield"), _part("aligned_reads_to_ref_st30_en110", "aligned_reads_to_ref", "full_alignment_yield"), _part("plr_unique_reads", "aligned_reads_to_ref", "plr_fraction_of_aligned"), _part("plr_unique_reads_full_alignment", "aligned_reads_to_ref_st30_en110", "plr_fraction_of_aligned_full")]) + " from doc",
    "run_wide": _W + "select run, max(pod5_reads) as pod5_reads, max(basecalled_reads) as basecalled_reads, max(active_channels) as active_channels, " + ", ".join(_WIDE) + ", cast(sum(aligned_reads_to_ref + aligned_reads_to_ref_st30_en110) as bigint) as aligned_reads_total from doc group by run",
    "run_directions": _W + "select run, " + ", ".join(_part(f"sum({m}) filter (reference = 'threading')", f"sum({m}) filter (reference in ('threading', 'revcomp'))", k) for k, m in (("aligned_ratio", "aligned_reads_to_ref"), ("full_ratio", "aligned_reads_to_ref_st30_en110"), ("plr_ratio", "plr_unique_reads"))) + " from doc group by run",
    "run_rejected_by_reference": _W + "select reference, round(median(coalesce(ratio_rejected_reads_aligned_reads * rejected_reads_count / nullif(aligned_reads_to_ref, 0), 0)) + 1e-8, 6) as median_frac_aligned_rejected from doc group by reference",
    "run_regions_by_reference": _W + "select reference, round(median(plr_unique_reads / cast(aligned_reads_to_ref as double)) + 1e-8, 6) as median_plr_fraction_of_aligned from doc group by reference",
    "run_dataset_table": _W + "select run as name, basecalled_reads as n_basecalls, n as n_aligned, v as n_valid, printf('%.2f', v * 100.0 / n) as valid_of_aligned from per_run join (select run, count(*) as n, count(*) filter (l_quantity >= 30) as v from al where reference = 'template' and flag & 4 = 0 group by run) using (run)",
    "run_missing": _W + "select run, 'summary' as missing_in from (select run from al where run <> 'run5' except select run from reads where run <> 'run3') union all select run, 'alignments' from (select run from reads where run <> 'run3' except select run from al where run <> 'run5')",
    "run_summary": _W + f""", d2 as (select * from doc where reference <> 'revcomp' or run <> 'run2')
      select g.run, g.reference, b.n_basecalled, coalesce(d2.aligned_reads_to_ref, 0) as n_aligned, coalesce(d2.plr_unique_reads, 0) as n_plr
      from (select distinct run, unnest({REFERENCES!r}) as reference from d2) g join (select run, max(basecalled_reads) as n_basecalled from d2 group by run) b using (run) left join d2 on d2.run = g.run and d2.reference = g.reference""",
    "run_first_alignments": _W + """select run, read_id, pos, reference, flag, "end", strand, n_alignments from (
      select *, count(*) over (partition by run, read_id) as n_alignments, row_number() over (partition by run, read_id order by pos, reference, flag, "end", strand) as k from al where flag & 4 = 0) where k = 1""",
    "run_mapped_ids": _W + """select distinct run, reference, read_id from al where flag & 4 = 0 and pos < 30 and "end" > 110""",
    "run_reads_of_ids": _W + "select run, read_id, channel from reads where end_reason in ('mux_change', 'signal_negative')",
}
