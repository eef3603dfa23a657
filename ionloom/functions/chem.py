"""Masses, adducts, formulas and isotope patterns as column expressions; small molecular graphs in Arrow UDFs."""

from __future__ import annotations

import itertools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Monoisotopic masses and the electron's. Fixed values.
MASS = {"C": 12.0, "H": 1.00782503207, "N": 14.0030740048, "O": 15.9949146196, "P": 30.97376163, "S": 31.97207100, "F": 18.99840322, "Cl": 34.96885268, "Br": 78.9183371, "I": 126.904473, "Na": 22.9897692809, "K": 38.96370668, "Si": 27.9769265325, "B": 11.0093054, "Se": 79.9165213}
ELECTRON = 0.00054857990
PROTON = MASS["H"] - ELECTRON
#: Names of the adducts that are known. Fixed values.
ADDUCTS = ["[M+H]+", "[M+NH4]+", "[M+Na]+", "[M+K]+", "[M-H2O+H]+", "[M-2H2O+H]+", "[M+2H]2+", "[M]+", "[M-H2O]+", "[M+CH3OH+H]+", "[M+CH3CN+H]+", "[M-H]-", "[M-H2O-H]-", "[M+CH2O2-H]-", "[M+C2H4O2-H]-", "[M+Cl]-", "[M]-", "[M-2H]-", "[M+Na-2H]-", "[2M+H]+", "[2M+Na]+", "[2M+NH4]+", "[2M+K]+", "[2M-H]-", "[2M+CH2O2-H]-", "[2M+C2H4O2-H]-", "[2M+Na-2H]-", "[3M+H]+", "[3M-H]-"]
#: Natural abundance ratios to the lightest isotope. Fixed values.
C13, N15, O17, O18, S33, S34, CL37, BR81, H2 = 0.01078, 0.00368, 0.00038, 0.00205, 0.00750, 0.04210, 0.32400, 0.97280, 0.000115
#: Neutral losses. Fixed values.
LOSSES = {"H2O": 18.010565, "NH3": 17.026549, "CO": 27.994915, "CO2": 43.989830, "CH2O": 30.010565, "HF": 19.998840, "CH4": 16.031300, "C2H2O": 42.010565, "hexose": 162.052824, "deoxyhexose": 146.057909, "glucuronide": 176.032088, "sulfate": 79.956816, "phosphate": 97.976895, "acetyl": 42.010565, "methyl": 14.015650}


def _weight(formula: str) -> float:
    return sum(MASS[e] * int(n or 1) for e, n in re.findall(r"([A-Z][a-z]?)(\d*)", formula))


def adduct_terms(name: str) -> tuple[int, int, float]:
    """(molecules n, charge z, mass shift d) read from a name such as [2M+Na-2H]-; neutral mass is (mz z - d) / n."""
    count, body, charge, sign = re.fullmatch(r"\[(\d*)M([^\]]*)\](\d*)([+-])", name).groups()
    z = int(charge or 1)
    shift = sum((1 if s == "+" else -1) * int(k or 1) * _weight(f) for s, k, f in re.findall(r"([+-])(\d*)([A-Z][A-Za-z0-9]*)", body))
    shift += (-1 if sign == "+" else 1) * z * ELECTRON
    if name == "[M-2H]-":  # taken as twice charged
        z, shift = 2, -2 * PROTON
    return int(count or 1), z, shift


def _lookup(adduct: Column, f) -> Column:
    out = None
    for name in ADDUCTS:
        out = (F if out is None else out).when(adduct == name, f(*adduct_terms(name)))
    return out


def neutral_mass(mz: Column, adduct: Column) -> Column:
    """Null for an unknown adduct."""
    return _lookup(adduct, lambda n, z, d: (mz * z - d) / n)


def ion_mz(mass: Column, adduct: Column) -> Column:
    return _lookup(adduct, lambda n, z, d: (mass * n + d) / z)


def ppm_error(observed: Column, expected: Column, signed: bool = True) -> Column:
    e = (observed - expected) / expected * 1e6
    return e if signed else F.abs(e)


def mass_prior(observed: Column, expected: Column, centre: float = -1.5, sigma: float = 3.5) -> Column:
    """exp(-((ppm error - centre) / sigma)^2 / 2) of an expected mass against an observed one; 1 at the instrument's offset."""
    return F.exp(-0.5 * F.pow((ppm_error(expected, observed) - centre) / sigma, 2))


def element_count(formula: Column, element: str) -> Column:
    """Atoms of an element in a formula; 0 if it has none."""
    found = F.regexp_extract_all(formula, F.lit(f"{element}(?![a-z])([0-9]*)"), F.lit(1))
    return F.coalesce(F.aggregate(found, F.lit(0), lambda s, n: s + F.when(n == "", 1).otherwise(n.try_cast("int"))), F.lit(0))


def formula_mass(formula: Column) -> Column:
    total = F.lit(0.0)
    for e, m in MASS.items():
        total = total + element_count(formula, e) * m
    return total


def isotope_ratios(formula: Column) -> Column:
    """M+1 and M+2 intensities relative to M, from a formula."""
    n = {e: element_count(formula, e) for e in ("C", "H", "N", "O", "S", "Cl", "Br")}
    one = n["C"] * C13 + n["H"] * H2 + n["N"] * N15 + n["O"] * O17 + n["S"] * S33
    two = one * one / 2 + n["O"] * O18 + n["S"] * S34 + n["Cl"] * CL37 + n["Br"] * BR81
    return F.struct(one.alias("m1"), two.alias("m2"))


def has_doublet(peaks: Column, precursor: Column, delta: float, low: float, high: float, share: float = 0.2, tol: float = 0.005) -> Column:
    """A fragment of at least `share` of the base peak, from 80 up to 15 below the precursor or at it, with a partner delta above of a fitting ratio."""
    top = F.array_max(F.transform(peaks, lambda p: p["it"]))
    large = F.filter(peaks, lambda p: (p["it"] >= share * top) & (p["mz"] >= 80) & (p["mz"] < precursor - 15))
    return F.exists(large, lambda p: F.exists(peaks, lambda q: (F.abs(q["mz"] - p["mz"] - delta) <= tol) & (q["it"] / p["it"]).between(low, high)))


def losses(peaks: Column, precursor: Column, tol: float = 0.015, share: float = 0.04) -> Column:
    """Names of the losses from the precursor that a peak of at least `share` of the base peak shows."""
    top = F.array_max(F.transform(peaks, lambda p: p["it"]))
    hits = [F.when((precursor - m > 20) & _near(peaks, precursor - m, tol, share * top), F.lit(k)) for k, m in LOSSES.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def _near(peaks: Column, mz: Column, tol: float, least: Column) -> Column:
    return F.exists(peaks, lambda p: (F.abs(p["mz"] - mz) <= tol) & (p["it"] >= least))


def numbers(text: Column) -> Column:
    """The numbers in a text, in order, whatever it is: a JSON array, a list in brackets, values with separators, or one value. Empty for none or null."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))


def first_number(text: Column, default: float = 30.0) -> Column:
    """The first number in a text, or the default."""
    return F.coalesce(F.get(numbers(text), F.lit(0)), F.lit(default))


def collision_energy(text: Column, default: float = 25.0) -> Column:
    """Mean of the absolute numbers in a text such as "[20.0, 45.0]"; the default if there is none."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: F.abs(x.cast("double")))
    return F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x) / F.size(numbers)).otherwise(F.lit(default))


def energy_class(text: Column) -> Column:
    """stepped for several energies in a text, low (to 25), mid (to 45) or high for one, unknown for none."""
    numbers = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    one = collision_energy(text)
    return F.when(F.size(numbers) > 1, "stepped").when(F.size(numbers) == 0, "unknown").when(one <= 25, "low").when(one <= 45, "mid").otherwise("high")


_VALENCE = {"B": 3, "C": 4, "N": 3, "O": 2, "P": 3, "S": 2, "F": 1, "Cl": 1, "Br": 1, "I": 1}
_ATOM = re.compile(r"\[(\d*)([A-Z][a-z]?|[bcnops])(@*)(H\d*)?([+-]\d*|[+]+|[-]+)?(?::\d+)?\]|(Cl|Br|[BCNOPSFI]|[bcnops])")


def read_smiles(text: str) -> tuple[list[str], list[int], list[tuple[int, int, float]]]:
    """Elements, hydrogens and bonds (i, j, order; 1.5 aromatic) of a SMILES of the organic subset with brackets. ValueError if it can't be read."""
    elements, explicit, bonds, aromatic = [], [], [], []
    stack, last, order, rings, at = [], None, None, {}, 0

    def bond(i, j, o):
        bonds.append((i, j, o if o is not None else 1.5 if aromatic[i] and aromatic[j] else 1.0))

    while at < len(text):
        c = text[at]
        if m := _ATOM.match(text, at):
            name = m[2] or m[6]
            elements.append(name.capitalize())
            aromatic.append(name.islower())
            h = m[4]
            explicit.append(None if m[6] else int(h[1:] or 1) if h else 0)
            if last is not None:
                bond(last, len(elements) - 1, order)
            last, order, at = len(elements) - 1, None, m.end()
            continue
        if c == "(":
            stack.append(last)
        elif c == ")":
            last = stack.pop()
        elif c in "-=#:/\\":
            order = {"-": 1.0, "=": 2.0, "#": 3.0, ":": 1.5}.get(c)
        elif c == ".":
            last = None
        elif c.isdigit() or c == "%":
            size = 3 if c == "%" else 1
            label = text[at : at + size]
            if label in rings:
                other, o = rings.pop(label)
                bond(other, last, order if order is not None else o)
            else:
                rings[label] = (last, order)
            order, at = None, at + size - 1
        else:
            raise ValueError(text)
        at += 1
    if rings or stack or not elements:
        raise ValueError(text)
    degree = [0.0] * len(elements)
    for i, j, o in bonds:
        degree[i] += o
        degree[j] += o
    hydrogens = []
    for i, e in enumerate(elements):
        if explicit[i] is not None:
            hydrogens.append(explicit[i])
            continue
        used, v = int(degree[i] + 0.5) if not aromatic[i] else int(degree[i]), _VALENCE[e]
        while v < used and e in "PSN":
            v += 2
        hydrogens.append(max(0, v - used))
    return elements, hydrogens, bonds


def hill_formula(elements: list[str], hydrogens: list[int]) -> str:
    counts: dict[str, int] = {}
    for e in elements:
        counts[e] = counts.get(e, 0) + 1
    if sum(hydrogens):
        counts["H"] = counts.get("H", 0) + sum(hydrogens)
    order = sorted(counts) if "C" not in counts else ["C", *(["H"] if "H" in counts else []), *sorted(set(counts) - {"C", "H"})]
    return "".join(e + (str(counts[e]) if counts[e] > 1 else "") for e in order)


@F.pandas_udf(T.StructType([T.StructField("formula", T.StringType()), T.StructField("mass", T.DoubleType())]))
def smiles_formula(smiles: pd.Series) -> pd.DataFrame:
    """Formula and monoisotopic mass of SMILES; null if unreadable."""
    out = []
    for s in smiles:
        try:
            e, h, _ = read_smiles(s or "")
            out.append((hill_formula(e, h), sum(MASS[x] for x in e) + sum(h) * MASS["H"]))
        except (ValueError, KeyError, IndexError, TypeError):
            out.append((None, None))
    return pd.DataFrame(out, columns=["formula", "mass"])


def fragments(elements: list[str], hydrogens: list[int], bonds: list[tuple], breaks: int = 2, most: int = 34) -> dict[float, int]:
    """Mass to the fewest broken bonds of every component that deleting up to `breaks` bonds leaves; beyond `most` bonds only the whole.

    Masses are not rounded; those that agree in 9 decimals (the same atoms added in another order) are one, as first found."""
    weight = [MASS[e] + h * MASS["H"] for e, h in zip(elements, hydrogens, strict=True)]
    found = {round(sum(weight), 9): (sum(weight), 0)}
    for n in range(1, breaks + 1) if len(bonds) <= most else ():
        for gone in itertools.combinations(range(len(bonds)), n):
            root = list(range(len(weight)))

            def find(x, root=root):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for k, (i, j, _) in enumerate(bonds):
                if k not in gone:
                    root[find(i)] = find(j)
            parts: dict[int, float] = {}
            for i, w in enumerate(weight):
                parts[find(i)] = parts.get(find(i), 0.0) + w
            if len(parts) > 1:
                for m in parts.values():
                    found.setdefault(round(m, 9), (m, n))
    return dict(found.values())


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def fragment_masses(smiles: pd.Series) -> pd.Series:
    """Ascending component masses of up to two bond breaks; null if unreadable."""
    out = []
    for s in smiles:
        try:
            out.append(sorted(fragments(*read_smiles(s or ""))))
        except (ValueError, KeyError, IndexError, TypeError):
            out.append(None)
    return pd.Series(out)
