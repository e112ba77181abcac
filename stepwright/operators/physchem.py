"""Properties of peptide sequences from their residues, as expressions over a string column."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hydropathy, mass of the whole amino acid, and pKa of side chains and ends, as published.
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}
MASS = {"A": 89.09, "R": 174.20, "N": 132.12, "D": 133.10, "C": 121.16, "Q": 146.15, "E": 147.13, "G": 75.07, "H": 155.16, "I": 131.17, "L": 131.17, "K": 146.19, "M": 149.21, "F": 165.19, "P": 115.13, "S": 105.09, "T": 119.12, "W": 204.23, "Y": 181.19, "V": 117.15}
BASIC = {"K": 10.5, "R": 12.5, "H": 6.0}
ACIDIC = {"D": 3.9, "E": 4.1, "C": 8.3, "Y": 10.1}
END_AMINO, END_ACID = 9.69, 2.34


def _table(values: dict[str, float]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))


def _letters(sequence: Column, kept: str) -> Column:
    """The wanted ones among the letters A to Z; others, such as a sharp s, have no upper case of one letter."""
    return F.regexp_replace(F.upper(F.regexp_replace(sequence, "[^A-Za-z]", "")), f"[^{kept}]", "")


def residues(sequence: Column) -> Column:
    """The letters of a sequence that name residues; case and all other signs don't count."""
    return F.split(_letters(sequence, "".join(HYDROPATHY)), "(?!$)")


def length(sequence: Column) -> Column:
    return F.length(_letters(sequence, "".join(HYDROPATHY)))


def _sum(sequence: Column, values: dict[str, float]) -> Column:
    t = _table(values)
    return F.aggregate(residues(sequence), F.lit(0.0), lambda a, r: a + F.coalesce(F.try_element_at(t, r), F.lit(0.0)))


def mean_hydropathy(sequence: Column) -> Column:
    """Mean over the residues; null without any."""
    return F.try_divide(_sum(sequence, HYDROPATHY), length(sequence))


def mass(sequence: Column) -> Column:
    """Sum of the masses of the amino acids as such; the water that bonds set free is not taken off."""
    return _sum(sequence, MASS)


def count_of(sequence: Column, letters: str) -> Column:
    return F.length(_letters(sequence, letters))


def share_of(sequence: Column, letters: str) -> Column:
    """Share of the residues that are among the letters; null without any."""
    return F.try_divide(count_of(sequence, letters), length(sequence))


def net_charge(sequence: Column, ph: float = 7.0) -> Column:
    """Charge at a pH, ends included; null without residues."""
    plus = sum((count_of(sequence, k) / F.lit(1 + 10 ** (ph - pk)) for k, pk in BASIC.items()), F.lit(1 / (1 + 10 ** (ph - END_AMINO))))
    minus = sum((count_of(sequence, k) / F.lit(1 + 10 ** (pk - ph)) for k, pk in ACIDIC.items()), F.lit(1 / (1 + 10 ** (END_ACID - ph))))
    return F.when(length(sequence) > 0, plus - minus)


def isoelectric_point(sequence: Column, passes: int = 40) -> Column:
    """The pH without net charge, by halving 0..14; a fold over the passes with the interval as state."""
    n = {k: count_of(sequence, k) for k in (*BASIC, *ACIDIC)}
    some = F.struct(*[c.cast("double").alias(k) for k, c in n.items()])

    def charge(c: Column, ph: Column) -> Column:
        plus = sum((c[k] / (1 + F.pow(F.lit(10.0), ph - pk)) for k, pk in BASIC.items()), 1 / (1 + F.pow(F.lit(10.0), ph - END_AMINO)))
        minus = sum((c[k] / (1 + F.pow(F.lit(10.0), pk - ph)) for k, pk in ACIDIC.items()), 1 / (1 + F.pow(F.lit(10.0), END_ACID - ph)))
        return plus - minus

    def halve(s: Column, _: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2
        up = charge(s["c"], mid) > 0
        return F.struct(F.when(up, mid).otherwise(s["low"]).alias("low"), F.when(up, s["high"]).otherwise(mid).alias("high"), s["c"].alias("c"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(14.0).alias("high"), some.alias("c"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(passes)), start, halve, lambda s: (s["low"] + s["high"]) / 2)
    return F.when(length(sequence) > 0, F.round(end, 3))
