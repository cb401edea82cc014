"""Ion arithmetic: adducts, formula masses, neutral masses."""

from __future__ import annotations

import re
from dataclasses import dataclass


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Masses in unified atomic mass units.
ELECTRON = 0.000548579909065
PROTON = 1.007276466621
ELEMENTS = {
    "H": 1.00782503223,
    "C": 12.0,
    "N": 14.00307400443,
    "O": 15.99491461957,
    "F": 18.99840316273,
    "Na": 22.9897692820,
    "K": 38.9637064864,
    "Cl": 34.968852682,
    "Br": 78.9183376,
    "Li": 7.0160034366,
    "Ca": 39.962590863,
    "P": 30.97376199842,
    "S": 31.9720711744,
}
# Other spellings of common adducts.
SPELLINGS = {"M+H": "[M+H]+", "M-H": "[M-H]-", "[M+H]1+": "[M+H]+", "[M-H]1-": "[M-H]-"}
# Adducts that take or give bare protons, by name: charge, protons, and a formula added (+) or lost (-).
PROTONATED = {
    "[M+H]+": (1, 1, ""),
    "[M-H2O+H]+": (1, 1, "-H2O"),
    "[M-2H2O+H]+": (1, 1, "-H4O2"),
    "[M-H]-": (-1, -1, ""),
    "[M-H2O-H]-": (-1, -1, "-H2O"),
    "[M+CH2O2-H]-": (-1, -1, "+CH2O2"),
    "[M+2H]2+": (2, 2, ""),
    "[M-2H]2-": (-2, -2, ""),
}
_NAME = re.compile(r"\[(\d*)M((?:[+-]\d*[A-Z][A-Za-z0-9]*)*)\](\d*)([+-])")
_ATOM = re.compile(r"([A-Z][a-z]?)(\d*)")


@dataclass(frozen=True)
class Adduct:
    charge: int
    shift: float
    molecules: int = 1


def formula_mass(formula: str) -> float:
    """Mass of a formula of ELEMENTS without brackets; ValueError otherwise."""
    atoms = _ATOM.findall(formula)
    if "".join(a + n for a, n in atoms) != formula or any(a not in ELEMENTS for a, _ in atoms):
        raise ValueError(f"not a formula of known elements: {formula!r}")
    return sum(ELEMENTS[a] * int(n or 1) for a, n in atoms)


def adduct(name: str) -> Adduct:
    """What an adduct's name says; ValueError where it says nothing known."""
    name = "".join(name.split())
    name = SPELLINGS.get(name, name)
    if name in PROTONATED:
        charge, protons, more = PROTONATED[name]
        moved = (1 if more[0] == "+" else -1) * formula_mass(more[1:]) if more else 0.0
        return Adduct(charge, protons * PROTON + moved)
    if not (m := _NAME.fullmatch(name)):
        raise ValueError(f"unknown adduct: {name!r}")
    charge = int(m[3] or 1) * (1 if m[4] == "+" else -1)
    terms = re.findall(r"([+-])(\d*)([A-Z][A-Za-z0-9]*)", m[2])
    return Adduct(charge, sum((1 if s == "+" else -1) * int(n or 1) * formula_mass(f) for s, n, f in terms) - charge * ELECTRON, int(m[1] or 1))


def neutral_mass(mz: Column, charge: Column, shift: Column, molecules: Column) -> Column:
    return (mz * F.abs(charge) - shift) / molecules


def precursor_mz(mass: Column, charge: Column, shift: Column, molecules: Column) -> Column:
    return (molecules * mass + shift) / F.abs(charge)


def with_adduct(rows: DataFrame, column: str = "adduct") -> DataFrame:
    """charge, shift, molecules of each row's adduct, null where it is unknown. Names are parsed once each, on the executors."""
    def parse(batches):
        for pdf in batches:
            out = []
            for name in pdf["name"]:
                try:
                    a = adduct(name)
                    out.append((name, a.charge, a.shift, a.molecules))
                except ValueError:
                    out.append((name, None, None, None))
            yield pd.DataFrame(out, columns=["name", "charge", "shift", "molecules"]).astype({"charge": "Int32", "shift": "Float64", "molecules": "Int32"})

    names = rows.select(F.col(column).alias("name")).filter("name is not null").distinct()
    parsed = names.mapInPandas(parse, "name string, charge int, shift double, molecules int")
    return rows.join(parsed, rows[column] == parsed["name"], "left").drop("name")


def formula_mass_of(formula: Column) -> Column:
    """Mass of a formula in the JVM; null where an element is unknown or the text is no formula."""
    table = F.create_map(*[x for k, v in ELEMENTS.items() for x in (F.lit(k), F.lit(v))])
    atoms = F.regexp_extract_all(formula, F.lit("[A-Z][a-z]?[0-9]*"), F.lit(0))
    mass = lambda a: F.try_element_at(table, F.regexp_extract(a, "^[A-Za-z]+", 0)) * F.coalesce(F.nullif(F.regexp_extract(a, "[0-9]+$", 0), F.lit("")).cast("int"), F.lit(1))
    return F.when((formula != "") & (F.array_join(atoms, "") == formula), F.aggregate(atoms, F.lit(0.0), lambda s, a: s + mass(a)))
