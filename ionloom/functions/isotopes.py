"""Isotope and loss evidence of peak lists against a candidate's formula or structure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.peaks import let, top_intensity
from .chem import C13, element_count, isotope_ratios

#: Isotope steps and ratio ranges: chlorine, bromine, sulfur. Fixed values.
DOUBLETS = {"Cl": (1.997050, 0.24, 0.40), "Br": (1.997954, 0.80, 1.20), "S": (1.995796, 0.025, 0.08)}
#: Mass steps to carbon-13 and oxygen-18 partners. Fixed values.
STEP_C13, STEP_O18 = 1.003355, 2.004246


def _partner(peaks: Column, mz: Column, tol: float) -> Column:
    """The most intense peak within tol of mz; null if there is none."""
    return F.array_max(F.transform(F.filter(peaks, lambda q: F.abs(q["mz"] - mz) < tol), lambda q: q["it"]))


def has_element(peaks: Column, precursor: Column, element: str, wide: float = 0.010, tol: float = 0.005, strict: float = 0.003) -> Column:
    """The precursor shows the element's doublet, or two fragments do, or one of at least 0.4 of the base peak does so closely."""
    step, low, high = DOUBLETS[element]

    def fits(x, p, t):
        return F.exists(x, lambda q: (F.abs(q["mz"] - p["mz"] - step) < t) & (q["it"] / p["it"]).between(low, high))

    def found(x):
        top = top_intensity(x)
        parent = F.exists(x, lambda p: (F.abs(p["mz"] - precursor) < wide) & fits(x, p, wide))
        large = F.filter(x, lambda p: (p["it"] >= 0.20 * top) & (p["mz"] >= 80) & (p["mz"] < precursor - 15))
        hits = F.filter(large, lambda p: fits(x, p, tol))
        return parent | (F.size(hits) >= 2) | F.exists(hits, lambda p: (p["it"] >= 0.40 * top) & fits(x, p, strict))

    return let(peaks, lambda x: F.coalesce(found(x), F.lit(False)))


def halogen_consistency(formula: Column, chlorine: Column, bromine: Column) -> Column:
    """1e-4 if the spectrum shows bromine (else chlorine) and the formula has none; 0.10 for bromine that the spectrum lacks; else 1."""
    cl, br = element_count(formula, "Cl"), element_count(formula, "Br")
    lacking = lambda n: F.when(n == 0, 1e-4).otherwise(1.0)
    return F.when(bromine, lacking(br)).when(chlorine, lacking(cl)).when(br > 0, 0.10).otherwise(1.0)


def carbon_estimates(peaks: Column, tol: float = 0.005, share: float = 0.05) -> Column:
    """Carbons of fragments with a carbon-13 partner: its relative intensity over the natural ratio, up to 60."""
    def found(x):
        large = F.filter(x, lambda p: p["it"] >= share * top_intensity(x))
        each = F.transform(large, lambda p: _partner(x, p["mz"] + STEP_C13, tol) / p["it"] / C13)
        return F.filter(each, lambda n: n.isNotNull() & (n > 0) & (n <= 60))

    return let(peaks, found)


def carbon_consistency(formula: Column, estimates: Column, sigma: float = 3.0) -> Column:
    """Gaussian of the mean number of carbons by which estimates exceed the formula's (from 1.5 over on); 0.5 without carbon."""
    c = element_count(formula, "C")
    over = lambda e: F.when(e <= c + 1.5, 0.0).otherwise(e - c)
    mean = F.aggregate(estimates, F.lit(0.0), lambda s, e: s + over(e)) / F.size(estimates)
    return F.when(F.size(estimates) == 0, 1.0).when(c == 0, 0.5).otherwise(F.greatest(F.lit(1e-4), F.exp(-mean * mean / (2 * sigma * sigma))))


def envelope(formula: Column, peaks: Column, precursor: Column, tol: float = 0.008, sigma1: float = 0.08, sigma2: float = 0.12) -> Column:
    """Gaussian agreement of the precursor's first and second isotope peaks with the formula's ratios; 1 without a precursor of at least 0.05."""
    def score(x):
        parent = F.try_element_at(F.filter(x, lambda p: F.abs(p["mz"] - precursor) < tol), F.lit(1))["it"]
        theory = isotope_ratios(formula)

        def part(step, want, sigma):
            gap = _partner(x, precursor + step, tol) / parent - want
            return F.coalesce(F.exp(-gap * gap / (2 * sigma * sigma)), F.lit(1.0))

        both = part(STEP_C13, theory["m1"], sigma1) * part(STEP_O18, theory["m2"], sigma2)
        return F.when(parent >= 0.05, F.greatest(F.lit(1e-4), both)).otherwise(1.0)

    return let(peaks, score)


def plausibility(losses: Column, groups: Column, needs: dict[str, str]) -> Column:
    """Product over observed losses (a map of name to relative intensity) of a bonus if the candidate has the group it needs, else a penalty; cut to 0.20 .. 1.25."""
    def step(m, name):
        need = None
        for loss, group in needs.items():
            need = (F if need is None else need).when(name == loss, F.lit(group))
        strength = F.least(F.lit(1.0), losses[name] * 2.0)
        bonus, penalty = F.least(F.lit(1.15), 1 + 0.15 * strength), F.greatest(F.lit(0.20), 1 - 0.60 * strength)
        return m * F.when(need.isNull(), 1.0).when(F.array_contains(groups, need), bonus).otherwise(penalty)

    product = F.aggregate(F.map_keys(losses), F.lit(1.0), step)
    return F.greatest(F.lit(0.20), F.least(F.lit(1.25), product))
