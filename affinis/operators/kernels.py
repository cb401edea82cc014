"""Kernels over peak arrays and bit vectors, as column expressions.

A spectrum is array<struct<mz, intensity>>. Nothing here leaves the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PEAK = "struct<mz: double, intensity: double>"


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column, of=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + of(v))


def peak(mz: Column, intensity: Column) -> Column:
    return F.struct(mz.cast("double").alias("mz"), intensity.cast("double").alias("intensity"))


def parsed(text: Column) -> Column:
    """array<double> of a JSON list, a list with blanks for commas, or nested lists of one; null where neither fits."""
    flat = F.regexp_replace(text, r"[\[\]\(\)]", " ")
    parts = F.filter(F.split(F.trim(flat), r"[,\s]+"), lambda x: x != "")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    return F.when(~F.exists(numbers, lambda x: x.isNull()), numbers)


def normalised(peaks: Column, transform: str = "sqrt") -> Column:
    """Intensities transformed (raw, sqrt, log1p) and divided by their maximum; zeros where that is not positive."""
    f = {"raw": lambda x: x, "sqrt": F.sqrt, "log1p": F.log1p}[transform]
    changed = F.transform(peaks, lambda p: peak(p["mz"], f(p["intensity"])))
    return let(changed, lambda c: let(F.coalesce(F.array_max(F.transform(c, lambda p: p["intensity"])), F.lit(0.0)), lambda top: F.transform(c, lambda p: peak(p["mz"], F.when(top > 0, p["intensity"] / top).otherwise(0.0)))))


def cleaned(peaks: Column, precursor: Column, relative_floor: float = 0.01, top_n: int = 200, transform: str = "sqrt", above: float = 2.0) -> Column:
    """In order: finite and not negative; not above the precursor by more than `above`; at least the floor of the base peak; the top_n highest; by m/z; transformed."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf"))
    kept = F.filter(peaks, lambda p: ok(p["mz"]) & ok(p["intensity"]))
    kept = F.when(precursor.isNotNull() & ~F.isnan(precursor), F.filter(kept, lambda p: p["mz"] <= precursor + above)).otherwise(kept)
    floored = let(kept, lambda k: let(F.coalesce(F.array_max(F.transform(k, lambda p: p["intensity"])), F.lit(0.0)), lambda top: F.filter(k, lambda p: p["intensity"] >= relative_floor * top)))
    highest = F.slice(F.array_sort(F.transform(floored, lambda p, i: F.struct((-p["intensity"]).alias("o"), (-i).alias("i"), p.alias("p")))), 1, top_n)
    by_mz = F.transform(F.array_sort(F.transform(highest, lambda x: F.struct(x["p"]["mz"].alias("m"), (-x["i"]).alias("i"), x["p"].alias("p")))), lambda x: x["p"])
    return normalised(by_mz, transform)


def matches(query: Column, reference: Column, tolerance: float, unit: str = "Da", shifts: list[Column] | None = None) -> Column:
    """array<struct<product, q, r>> of a one-to-one matching, greedy by product of intensities (then q, then r, all descending).

    Pairs are those within the tolerance after any of the shifts of the query; ppm is of the unshifted query m/z.
    """
    shifts = shifts or [F.lit(0.0)]
    pair = "struct<product: double, q: int, r: int>"

    def of_query(p: Column, qi: Column) -> Column:
        width = F.lit(tolerance) if unit == "Da" else p["mz"] * tolerance * 1e-6
        near = lambda r: F.exists(F.array(*shifts), lambda s: F.abs(p["mz"] + s - r["mz"]) <= width)
        numbered = F.transform(reference, lambda r, ri: F.struct(r["mz"].alias("mz"), r["intensity"].alias("intensity"), ri.alias("ri")))
        return F.transform(F.filter(numbered, near), lambda r: F.struct((p["intensity"] * r["intensity"]).alias("product"), qi.cast("int").alias("q"), r["ri"].cast("int").alias("r")))

    pairs = F.reverse(F.array_sort(F.flatten(F.transform(query, of_query))))
    start = F.expr(f"cast(array() as array<{pair}>)")
    take = lambda acc, x: F.when(F.exists(acc, lambda y: (y["q"] == x["q"]) | (y["r"] == x["r"])), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(pairs, start, take)


def cosine(query: Column, reference: Column, tolerance: float = 0.01, unit: str = "Da", shifts: list[Column] | None = None) -> Column:
    """struct<score, matched, explained>: product over the full norms; share of the query's intensity that matched. Zero norms give zeros."""
    norm = lambda s: F.sqrt(total(s, lambda p: p["intensity"] * p["intensity"]))

    def scored(m: Column) -> Column:
        size = norm(query) * norm(reference)
        whole = total(query, lambda p: p["intensity"])
        explained = F.when(whole > 0, total(m, lambda x: F.element_at(query, x["q"] + 1)["intensity"]) / whole).otherwise(0.0)
        score = F.when(size > 0, total(m, lambda x: x["product"]) / size).otherwise(0.0)
        return F.struct(F.least(score, F.lit(1.0)).alias("score"), F.when(size > 0, F.size(m)).otherwise(0).alias("matched"), F.when(size > 0, explained).otherwise(0.0).alias("explained"))

    return let(matches(query, reference, tolerance, unit, shifts), scored)


def modified_cosine(query: Column, reference: Column, query_precursor: Column, reference_precursor: Column, tolerance: float = 0.01) -> Column:
    """Peaks may match as they are or shifted by the difference of the precursors, in one pool."""
    return cosine(query, reference, tolerance, shifts=[F.lit(0.0), reference_precursor - query_precursor])


def losses(peaks: Column, precursor: Column) -> Column:
    found = F.filter(F.transform(peaks, lambda p: peak(precursor - p["mz"], p["intensity"])), lambda p: p["mz"] >= 0)
    return F.array_sort(found)


def neutral_loss_cosine(query: Column, reference: Column, query_precursor: Column, reference_precursor: Column, tolerance: float = 0.01) -> Column:
    return cosine(losses(query, query_precursor), losses(reference, reference_precursor), tolerance)


def hit_score(direct: Column, modified: Column, loss: Column) -> Column:
    return 0.60 * direct + 0.25 * modified + 0.15 * loss


def binned(peaks: Column, width: float, most: float, how: str = "max") -> Column:
    """map bin -> intensity: floor(mz / width), bins from 0 below ceil(most / width)."""
    n = math.ceil(most / width)
    at = F.filter(F.transform(peaks, lambda p: F.struct(F.floor(p["mz"] / width).cast("int").alias("b"), p["intensity"].alias("i"))), lambda x: (x["b"] >= 0) & (x["b"] < n))

    def values(a: Column) -> Column:
        of = lambda b: F.transform(F.filter(a, lambda x: x["b"] == b), lambda x: x["i"])
        bins = F.array_distinct(F.transform(a, lambda x: x["b"]))
        return F.map_from_entries(F.transform(bins, lambda b: F.struct(b, (F.array_max(of(b)) if how == "max" else total(of(b))))))

    return let(at, values)


def binned_cosine(a: Column, b: Column) -> Column:
    """Cosine of two binned spectra; zero norms give 0."""
    dot = total(F.map_keys(a), lambda k: F.coalesce(F.try_element_at(a, k) * F.try_element_at(b, k), F.lit(0.0)))
    norm = lambda m: F.sqrt(total(F.map_values(m), lambda v: v * v))
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size).otherwise(0.0)


def entropy(p: Column) -> Column:
    return -total(p, lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0))


def entropy_weighted(peaks: Column) -> Column:
    """Peaks as probabilities; of spectra with entropy S below 3, raised to the power 0.25 + 0.25 S and scaled again."""

    def scaled(s: Column) -> Column:
        return let(total(s, lambda p: p["intensity"]), lambda t: F.transform(s, lambda p: peak(p["mz"], F.when(t > 0, p["intensity"] / t).otherwise(0.0))))

    def weighed(s: Column) -> Column:
        return let(entropy(F.transform(s, lambda p: p["intensity"])), lambda e: F.when(e < 3, scaled(F.transform(s, lambda p: peak(p["mz"], F.pow(p["intensity"], 0.25 + 0.25 * e))))).otherwise(s))

    return let(scaled(peaks), weighed)


def entropy_similarity(query: Column, reference: Column, tolerance: float, shift: Column | None = None) -> Column:
    """1 - Jensen-Shannon divergence / ln 2 of two probability spectra in order of m/z, merged first fit: not the best matching."""
    shift = F.lit(0.0) if shift is None else shift

    def step(acc: Column, _: Column) -> Column:
        q, r = F.try_element_at(query, acc["i"] + 1), F.try_element_at(reference, acc["j"] + 1)
        delta = q["mz"] - (r["mz"] + shift)
        no_q, no_r = q.isNull(), r.isNull()
        use_q = ~no_q & (no_r | (delta <= tolerance))
        use_r = ~no_r & (no_q | (delta >= -tolerance))
        p = 0.5 * (F.when(use_q, q["intensity"]).otherwise(0.0) + F.when(use_r, r["intensity"]).otherwise(0.0))
        return F.struct((acc["i"] + use_q.cast("int")).alias("i"), (acc["j"] + use_r.cast("int")).alias("j"), (acc["h"] - F.when(p > 0, p * F.log(p)).otherwise(0.0)).alias("h"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0.0).alias("h"))
    mixture = F.aggregate(F.sequence(F.lit(1), F.size(query) + F.size(reference)), start, step, lambda a: a["h"])
    own = 0.5 * (entropy(F.transform(query, lambda p: p["intensity"])) + entropy(F.transform(reference, lambda p: p["intensity"])))
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (mixture - own) / math.log(2)))
    return F.when((F.size(query) > 0) & (F.size(reference) > 0), value).otherwise(0.0)


def shifted_entropy(query: Column, reference: Column, tolerance: float, shift: Column) -> Column:
    """The better of the direct and the shifted similarity; shifts of 0.001 or less are none."""
    direct = entropy_similarity(query, reference, tolerance)
    return F.when(F.abs(shift) > 0.001, F.greatest(direct, entropy_similarity(query, reference, tolerance, shift))).otherwise(direct)


def packed(bits: Column) -> Column:
    """Words of 64 bits, lowest bit first, of an array of booleans."""
    # Named once: what a lambda looks into is made anew for each element.
    return let(bits, _words)


def _words(bits: Column) -> Column:
    words = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(bits) / 64).cast("int") - 1))
    word = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(F.when(F.coalesce(F.get(bits, w * 64 + i), F.lit(False)), F.expr("1L")).otherwise(F.expr("0L")) * _power(i)))
    return F.transform(words, word)


def _power(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def tanimoto(a: Column, b: Column) -> Column:
    """Of two arrays of words; 1 where both are empty."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, v: s + v)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseOR(y))), F.lit(0), lambda s, v: s + v)
    return F.when(either > 0, both / either).otherwise(1.0)


def compatibility(p: Column, bits: Column, eps: float = 1e-7) -> Column:
    """struct of a probability vector's agreement with a bit vector (array<int>): soft intersection, expected and binary Tanimoto, cosine, cross entropy."""
    zipped = F.zip_with(p, bits, lambda a, b: F.struct(a.cast("double").alias("p"), b.cast("double").alias("b")))

    def scored(z: Column) -> Column:
        inter, sp, sb = total(z, lambda x: x["p"] * x["b"]), total(z, lambda x: x["p"]), total(z, lambda x: x["b"])
        hard = total(z, lambda x: F.when((x["p"] >= 0.5) & (x["b"] > 0), 1.0).otherwise(0.0))
        either = total(z, lambda x: F.when((x["p"] >= 0.5) | (x["b"] > 0), 1.0).otherwise(0.0))
        norm = F.sqrt(total(z, lambda x: x["p"] * x["p"])) * F.sqrt(sb)
        safe = lambda v: F.least(F.lit(1 - eps), F.greatest(F.lit(eps), v))
        bce = -total(z, lambda x: x["b"] * F.log(safe(x["p"])) + (1 - x["b"]) * F.log(1 - safe(x["p"]))) / F.size(z)
        return F.struct(
            inter.alias("soft_intersection"), F.when(sp + sb - inter > 0, inter / (sp + sb - inter)).otherwise(1.0).alias("expected_tanimoto"),
            F.when(either > 0, hard / either).otherwise(1.0).alias("binary_tanimoto"), F.when(norm > 0, inter / norm).otherwise(0.0).alias("cosine"), bce.alias("bce"),
        )

    return let(zipped, scored)


#: Six scores of a spectrum, in order.
FRAGMENT_SCORES = ("peak_fraction", "intensity_fraction", "matched_count", "top_intensity_fraction", "mass_weighted_score", "neutral_loss_score")


def product_ions(neutral: Column, polarity: Column, hydrogen: float, proton: float, electron: float) -> Column:
    """array<double> of the ions that neutral fragments may give: shifts by hydrogens and protons of the polarity ("positive", "negative", else unknown); above zero, once each."""
    of = lambda *shifts: F.array(*[F.lit(float(x)) for x in shifts])
    shifts = F.when(polarity == "positive", of(-hydrogen - electron, -proton, 0, proton)).when(polarity == "negative", of(-proton, 0, hydrogen + electron)).otherwise(of(-proton, 0, proton))
    ions = F.flatten(F.transform(neutral, lambda m: F.transform(shifts, lambda s: m + s)))
    return F.array_sort(F.array_distinct(F.filter(ions, lambda x: x > 0)))


def fragment_scores(peaks: Column, ions: Column, losses: Column, precursor: Column, tolerance: float = 0.02, top: int = 10) -> Column:
    """struct of FRAGMENT_SCORES: how many peaks lie within the tolerance of an ion, what share of them, of their intensity, of the `top` highest, of intensity
    times m/z; and of the intensity of peaks below the precursor, the share whose loss is one of losses. Peaks that are not finite or not above 0 don't count; no peaks give zeros."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (x < float("inf"))
    kept = F.filter(peaks, lambda p: ok(p["mz"]) & ok(p["intensity"]) & (p["mz"] > 0) & (p["intensity"] >= 0))
    hit = lambda x, masses: F.coalesce(F.exists(masses, lambda t: F.abs(t - x) <= tolerance), F.lit(False)).cast("double")
    flagged = F.transform(kept, lambda p: F.struct(p["mz"].alias("mz"), p["intensity"].alias("i"), hit(p["mz"], ions).alias("h"), (precursor - p["mz"]).alias("d"), hit(precursor - p["mz"], losses).alias("l")))

    def scored(f: Column) -> Column:
        share = lambda w, h: let(total(f, w), lambda t: F.when(t > 0, total(f, lambda x: w(x) * x[h]) / t).otherwise(0.0))
        best = F.slice(F.array_sort(F.transform(f, lambda x: F.struct((-x["i"]).alias("o"), x["mz"].alias("m"), x["h"].alias("h")))), 1, top)
        values = (
            share(lambda x: F.lit(1.0), "h"), share(lambda x: x["i"], "h"), total(f, lambda x: x["h"]), F.when(F.size(best) > 0, total(best, lambda x: x["h"]) / F.size(best)).otherwise(0.0),
            share(lambda x: x["i"] * x["mz"], "h"), share(lambda x: F.when(x["d"] > 0, x["i"]).otherwise(0.0), "l"),
        )
        return F.struct(*[v.alias(n) for v, n in zip(values, FRAGMENT_SCORES, strict=True)])

    return let(flagged, scored)


def unpacked(words: Column, n: int) -> Column:
    """array<boolean> of the first n bits of words, lowest bit first."""
    return let(words, lambda w: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.call_function("shiftright", F.get(w, F.floor(i / 64).cast("int")), (i % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1))


def feature_vector(peaks: Column, metadata: list[Column], width: float = 1.0, most: float = 1200.0) -> Column:
    """array<double>: bins over their maximum, then metadata, with 0 for what is not finite."""
    bins = binned(peaks, width, most)
    clean = lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x.cast("double"))

    def dense(b: Column) -> Column:
        top = F.coalesce(F.array_max(F.map_values(b)), F.lit(0.0))
        return F.transform(F.sequence(F.lit(0), F.lit(math.ceil(most / width) - 1)), lambda i: F.when(top > 0, F.coalesce(F.try_element_at(b, i), F.lit(0.0)) / top).otherwise(0.0))

    return F.concat(let(bins, dense), F.array(*[clean(m) for m in metadata]))
