"""Mixing sources to target shares of a total size in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .tokens import BYTE_BPE_50K, DEFAULT_DIR, token_count


def uniform(*cols, seed: int = 0):
    """A number in [0, 1) that depends on the columns' values and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def source_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tokenizer: str = BYTE_BPE_50K,
    tokenizer_dir: str = DEFAULT_DIR,
) -> DataFrame:
    """Each document's id, source and size in tokens, written once to the shared folder.

    Only the three named columns are read; other columns, whatever their names, don't matter.
    """
    return materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            token_count(F.col(text_col), tokenizer, tokenizer_dir).alias("n_tokens"),
        ),
        "tokens",
    )


def repetition_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """The rate at which each row of targets has to repeat the documents of its source.

    The rate is the wanted tokens over the source's tokens, at most max_repeats and at least 0. It
    is 0 for a source without tokens, and for rows in which share, size or cap is missing. A row
    falls short when all documents, repeated max_repeats times, don't reach the wanted tokens.
    """
    per_source = sizes.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    rows = targets.select("mix_id", "source", "target_share", "max_repeats", "mix_tokens")
    joined = rows.join(per_source, "source", "left")
    have = F.coalesce("source_tokens", F.lit(0))
    cap = F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))
    wanted = F.col("target_share") * F.col("mix_tokens")
    return joined.select(
        "mix_id",
        "source",
        "target_share",
        "max_repeats",
        "mix_tokens",
        have.alias("source_tokens"),
        wanted.alias("wanted_tokens"),
        F.when(have > 0, F.least(F.greatest(F.coalesce(wanted / have, F.lit(0.0)), F.lit(0.0)), cap.cast("double")))
        .otherwise(F.lit(0.0))
        .alias("rate"),
        F.coalesce(have * cap < wanted, F.lit(False)).alias("short"),
    )


def emit_mix(mix: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of a mix, each document as often as the mix repeats it: (mix_id, doc_id, copy, source, text).

    copy counts from 1. A doc_id that occurs twice in docs must not be in the mix. Other columns aren't read.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return mix.join(texts, "doc_id").select("mix_id", "doc_id", copies, "source", "text")


def mix_sources(docs: DataFrame, targets: DataFrame, seed: int = 17, **read) -> tuple[DataFrame, DataFrame]:
    """Mix documents to the shares of targets (mix_id, source, target_share, max_repeats, mix_tokens).

    Every document of a source appears floor(rate) times, and once more with a probability of the
    rate's fraction, drawn from a hash of seed, mix and document. Returns the mix with one row per
    document, mix and source (doc_id, mix_id, source, copies, n_tokens of one copy), and the report
    with one row per row of targets: wanted and reached tokens, wanted and reached share, short.

    Documents without source belong to no mix. Documents whose text is null or empty have no tokens
    and are repeated like any others. A doc_id that occurs twice is two documents with the same
    draw. Rows of targets that repeat a source add up. Empty tables give empty results, sources
    without documents a reached share of 0.
    """
    sizes = source_tokens(docs, **read)
    rates = materialize(repetition_rates(sizes, targets), "rates")
    whole = F.floor("rate")
    copies = whole + (uniform("mix_id", "source", "doc_id", seed=seed) < F.col("rate") - whole).cast("long")
    # One row per target and all documents of its source; targets don't grow, so Spark broadcasts them by size.
    mix = (
        sizes.join(rates.select("mix_id", "source", "rate"), "source")
        .select("doc_id", "mix_id", "source", copies.alias("copies"), "n_tokens")
        .where("copies > 0")
    )
    reached = mix.groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("reached_tokens"))
    per_mix = reached.groupBy("mix_id").agg(F.sum("reached_tokens").alias("all_tokens"))
    report = (
        rates.join(reached, ["mix_id", "source"], "left")
        .join(per_mix, "mix_id", "left")
        .select(
            "mix_id",
            "source",
            "target_share",
            "max_repeats",
            "source_tokens",
            "wanted_tokens",
            "rate",
            F.coalesce("reached_tokens", F.lit(0)).alias("reached_tokens"),
            F.coalesce(F.try_divide("reached_tokens", "all_tokens"), F.lit(0.0)).alias("reached_share"),
            "short",
        )
    )
    return mix, report
