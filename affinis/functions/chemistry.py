"""Structure chemistry behind a protocol: what a table of precomputed structures says, or another backend of the caller; never a guess."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a backend adds for each distinct structure.
COLUMNS = {"canonical_smiles": "string", "inchikey14": "string", "formula": "string", "exact_mass": "double", "scaffold": "string"}
#: What it adds on request: 64-bit words of a circular fingerprint, descriptors, masses of fragments and of what they lose, the structure without isotopes.
MORE = {
    "words": "array<bigint>", "candidate_heteroatom_count": "double", "candidate_ring_count": "double", "candidate_aromatic_fraction": "double", "candidate_logp": "double",
    "fragments": "array<double>", "losses": "array<double>", "plain_smiles": "string",
}


class Backend(Protocol):
    def describe(self, structures: DataFrame) -> DataFrame:
        """smiles and COLUMNS for each row of a frame of distinct smiles; null where a structure is not valid."""

    def more(self, structures: DataFrame) -> DataFrame:
        """smiles and MORE, alike."""


class Precomputed:
    """Looks structures up in a table that has smiles and COLUMNS."""

    def __init__(self, known: DataFrame):
        self.known = known

    def describe(self, structures: DataFrame) -> DataFrame:
        return structures.join(self.known.select("smiles", *COLUMNS), "smiles", "left")

    def more(self, structures: DataFrame) -> DataFrame:
        return structures.join(self.known.select("smiles", *MORE), "smiles", "left")


def described(rows: DataFrame, backend: Backend, column: str = "smiles") -> DataFrame:
    """rows with COLUMNS of their structure; each distinct structure is worked on once. An acyclic scaffold is named after the key."""
    once = backend.describe(rows.select(F.col(column).alias("smiles")).filter("smiles is not null").distinct())
    once = once.withColumn("scaffold", F.coalesce(F.nullif("scaffold", F.lit("")), F.concat(F.lit("ACYCLIC:"), "inchikey14")))
    return rows.join(once.withColumnRenamed("smiles", "__smiles"), F.col(column) == F.col("__smiles"), "left").drop("__smiles")


def comparison_key(text):
    """A key of 14 capitals passes; null for anything else, which needs a backend."""
    return F.when(F.rlike(text, F.lit("^[A-Z]{14}$")), text)


def fingerprint_index(candidates: DataFrame, backend: Backend, key: str = "inchikey14") -> DataFrame:
    """key, words of each candidate, one row for each key; structures without a fingerprint are left out, see unindexed."""
    rows = _with_more(candidates, backend, ["words"]).filter("words is not null")
    return rows.groupBy(key).agg(F.min_by("words", "smiles").alias("words"))


def unindexed(candidates: DataFrame, backend: Backend) -> int:
    """How many candidates have no fingerprint."""
    return _with_more(candidates, backend, ["words"]).filter("words is null").count()


def with_descriptors(rows: DataFrame, backend: Backend) -> DataFrame:
    """rows with the four descriptors of their structure; null where it is not valid."""
    return _with_more(rows, backend, [c for c in MORE if c.startswith("candidate_")])


def with_fragments(rows: DataFrame, backend: Backend) -> DataFrame:
    """rows with the masses of their structure's fragments, and of what these lose."""
    return _with_more(rows, backend, ["fragments", "losses"])


def without_isotopes(candidates: DataFrame, backend: Backend, isotopic) -> DataFrame:
    """candidates whose structures name no isotope; smiles, key, formula and mass are those of the plain structure where `isotopic` held, unless that is not valid.

    One row for each key stays, the one of the lowest candidate_id, as plain structures may be there already.
    """
    new = {"smiles": "plain_smiles", "canonical_smiles": "new.canonical_smiles", "inchikey14": "new.inchikey14", "formula": "new.formula", "exact_mass": "new.exact_mass"}
    marked = _with_more(candidates.select("smiles").filter(isotopic).distinct(), backend, ["plain_smiles"]).filter("plain_smiles is not null")
    plain = described(marked, backend, "plain_smiles").select(F.col("smiles").alias("__old"), F.struct("plain_smiles", *COLUMNS).alias("new"))
    rows = candidates.join(plain, F.col("smiles") == F.col("__old"), "left").drop("__old")
    rows = rows.withColumns({c: F.coalesce(f"new.{v.split('.')[-1]}", c) for c, v in new.items() if c in candidates.columns}).drop("new")
    return rows.groupBy("inchikey14").agg(F.min_by(F.struct(*[c for c in candidates.columns if c != "inchikey14"]), "candidate_id").alias("b")).select("inchikey14", "b.*").select(*candidates.columns)


def _with_more(rows: DataFrame, backend: Backend, columns: list[str]) -> DataFrame:
    once = backend.more(rows.select("smiles").filter("smiles is not null").distinct()).select(F.col("smiles").alias("__smiles"), *columns)
    return rows.join(once, F.col("smiles") == F.col("__smiles"), "left").drop("__smiles")
