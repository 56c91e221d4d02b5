"""Body-composition formulas as expressions; missing or impossible input gives null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Density intercept and slope by sex and highest age of the band; the last band is open.
DURNIN_WOMERSLEY = {
    "M": ((19, 1.1620, 0.0630), (29, 1.1631, 0.0632), (39, 1.1422, 0.0544), (49, 1.1620, 0.0700), (None, 1.1715, 0.0779)),
    "F": ((19, 1.1549, 0.0678), (29, 1.1599, 0.0717), (39, 1.1423, 0.0632), (49, 1.1333, 0.0612), (None, 1.1339, 0.0645)),
}


def _sum(*cols: Column) -> Column:
    return reduce(lambda a, b: a + b, cols)


def siri(density: Column) -> Column:
    return 495 / density - 450


def durnin_womersley(sex: Column, age: Column, *folds: Column) -> Column:
    """Percent fat of four positive skinfolds."""
    total = _sum(*folds)
    density = None
    for s, bands in DURNIN_WOMERSLEY.items():
        for high, c, m in bands:
            hit = (sex == s) & (age.isNotNull() if high is None else age <= high)
            value = c - m * F.log10(total)
            density = F.when(hit, value) if density is None else density.when(hit, value)
    return F.when(reduce(lambda a, b: a & b, (f > 0 for f in folds)), siri(density))


def faulkner(triceps: Column, subscapular: Column, suprailiac: Column, abdominal: Column) -> Column:
    return 0.153 * _sum(triceps, subscapular, suprailiac, abdominal) + 5.783


def yuhasz(*six: Column) -> Column:
    return 0.1051 * _sum(*six) + 2.585


def petroski(sex: Column, age: Column, *four: Column) -> Column:
    """Men only."""
    s = _sum(*four)
    density = 1.10726863 - 0.00081201 * s + 0.00000212 * s * s - 0.00041761 * age
    return F.when(sex == "M", siri(density))


def fat_from_lean_mass(weight: Column, lean: Column) -> Column:
    return F.when((weight > 0) & (lean > 0), (weight - lean) / weight * 100)


def corrected_girth(girth_cm: Column, fold_mm: Column) -> Column:
    return girth_cm - F.pi() * fold_mm / 10


def endomorphy(triceps: Column, subscapular: Column, supraspinale: Column, height_cm: Column) -> Column:
    x = _sum(triceps, subscapular, supraspinale) * 170.18 / height_cm
    return -0.7182 + 0.1451 * x - 0.00068 * x * x + 0.0000014 * x * x * x


def ectomorphy(height_cm: Column, weight_kg: Column) -> Column:
    h = height_cm / F.cbrt(weight_kg)
    return F.when(h >= 40.75, 0.732 * h - 28.58).when(h > 38.25, 0.463 * h - 17.63).when(h.isNotNull(), 0.1)


def surface_area(weight_kg: Column, height_cm: Column) -> Column:
    return 0.007184 * F.pow(height_cm, F.lit(0.725)) * F.pow(weight_kg, F.lit(0.425))


def fat_free_index(fat_free_kg: Column, height_m: Column, normalised: bool = False) -> Column:
    plain = fat_free_kg / (height_m * height_m)
    return plain + 6.1 * (1.80 - height_m) if normalised else plain


def limb_area(girth_cm: Column) -> Column:
    return girth_cm * girth_cm / (4 * F.pi())
