"""Derived body-composition metrics of wide assessments, long: one row for each date and metric that can be computed."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import anthropometry as A
from ..functions import dates
from ..functions.numbers import half_even

# The report's column names.
FAT_SEDENTARY, FAT_ATHLETE = "Percentagem Massa Gorda (Sedentários)", "Percentagem Massa Gorda (Atletas)"
WEIGHT, HEIGHT, LEAN, MUSCLE = "Peso", "Altura", "Massa Magra", "Massa Muscular"
WAIST, HIP, NAVEL = "Perímetro Cintura", "Perímetro Anca/Glúteo", "Perímetro Umbigo"
ARM, THIGH, CALF = "Perímetro Braço", "Perímetro Coxa", "Perímetro Gémeo"
FOLDS = {
    "triceps": "Prega Cutânea Triciptal", "subscapular": "Prega Cutânea Subescapular", "biceps": "Prega Cutânea Bicipital", "supraspinale": "Prega cutânea Supraespinhal",
    "abdominal": "Prega Cutânea Abdominal", "thigh": "Prega Cutânea Coxa", "calf": "Prega Gêmeo", "suprailiac": "Prega Cutânea Supra-ilíaca",
}
COLUMNS = (FAT_SEDENTARY, FAT_ATHLETE, WEIGHT, HEIGHT, LEAN, MUSCLE, WAIST, HIP, NAVEL, ARM, THIGH, CALF, *FOLDS.values())
LIMBS, TRUNK = ("triceps", "biceps", "thigh", "calf"), ("subscapular", "suprailiac", "abdominal")
SIX = ("triceps", "subscapular", "suprailiac", "abdominal", "thigh", "calf")
ORIGINS = ("printed", "model", "lean mass", "gap", "skinfolds")
_ROW = "struct<group:string,metric:string,unit:string,value:double,note:string>"


def calibrate_gap(wide: DataFrame, by: list[str]) -> DataFrame:
    """``by, gap, n, origin``: how far the athlete reading lies below the sedentary one, from printed values, else from the lean mass.

    An entity without either has a null gap.
    """
    printed = F.col(f"`{FAT_SEDENTARY}`") - F.col(f"`{FAT_ATHLETE}`")
    implied = F.col(f"`{FAT_SEDENTARY}`") - A.fat_from_lean_mass(F.col(f"`{WEIGHT}`"), F.col(f"`{LEAN}`"))
    sums = wide.groupBy(*by).agg(F.avg(printed).alias("_p"), F.count(printed).alias("_np"), F.avg(implied).alias("_i"), F.count(implied).alias("_ni"))
    first, second = F.col("_np") > 0, F.col("_ni") > 0
    return sums.select(
        *by, F.coalesce("_p", "_i").alias("gap"), F.when(first, F.col("_np")).otherwise(F.col("_ni")).alias("n"),
        F.when(first, "printed").when(second, "lean mass").otherwise("").alias("origin"),
    )


def derive(wide: DataFrame, by: list[str], sex: Column, age: Column, model: Column | None = None) -> DataFrame:
    """``by, date, season, phase, group, metric, unit, value, note`` of every metric that a row's measurements allow.

    ``wide`` has ``by``, ``date`` and any of :data:`COLUMNS`; a missing one counts
    as not measured. The athlete's percentage is the first there is of the
    printed one, the ``model``'s, that of the lean mass, the sedentary one less the
    entity's gap, and the skinfolds'; the note names which.
    """
    sheet = wide.join(calibrate_gap(_whole(wide), by).select(*by, F.col("gap").alias("_gap")), by, "left")
    sheet = _whole(sheet).select("*", sex.alias("_sex"), age.alias("_age"), (F.lit(None).cast("double") if model is None else model).alias("_model"))
    staged = sheet.select("*", *(x.alias(n) for n, x in _stage().items()))
    staged = staged.select("*", *(x.alias(n) for n, x in _second_stage().items()))
    rows = F.array(*(F.struct(F.lit(g), F.lit(m) if isinstance(m, str) else m, F.lit(u), v, F.lit(n) if isinstance(n, str) else n).cast(_ROW) for g, m, u, v, n in _metrics()))
    long = staged.select(*by, "date", F.inline(rows)).filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != math.inf))
    return long.select(
        *by, "date", dates.season(F.col("date")).alias("season"), dates.phase(F.col("date")).alias("phase"), "group", "metric", "unit", half_even(F.col("value"), 2).alias("value"), "note"
    )


def _whole(df: DataFrame) -> DataFrame:
    """With all columns that formulas read, missing ones as null."""
    return df.select("*", *(F.lit(None).cast("double").alias(c) for c in COLUMNS if c not in df.columns))


def _c(name: str) -> Column:
    return F.col(f"`{FOLDS.get(name, name)}`")


def _some(c: Column) -> Column:
    """A measured value; 0 counts as not measured."""
    return F.when(c != 0, c)


def _known_sum(names) -> Column:
    """The sum of the folds that were measured; null without any."""
    cols = [_c(n) for n in names]
    return F.when(F.coalesce(*cols).isNotNull(), reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in cols)))


def _stage() -> dict[str, Column]:
    """What several metrics share, from the measurements."""
    f = {k: _c(k) for k in FOLDS}
    lean = A.fat_from_lean_mass(_c(WEIGHT), _c(LEAN))
    four = A.faulkner(f["triceps"], f["subscapular"], f["suprailiac"], f["abdominal"])
    ladder = [_c(FAT_ATHLETE), F.col("_model"), lean, _c(FAT_SEDENTARY) - F.col("_gap"), four]
    origin = F.when(ladder[0].isNotNull(), ORIGINS[0])
    for name, x in zip(ORIGINS[1:], ladder[1:], strict=True):
        origin = origin.when(x.isNotNull(), name)
    return {
        "_athlete": F.coalesce(*ladder), "_origin": origin, "_faulkner": four,
        "_fat": _some(_c(WEIGHT)) * _some(_c(FAT_SEDENTARY)) / 100, "_height": _some(_c(HEIGHT)) / 100,
        "_thigh": A.corrected_girth(_c(THIGH), f["thigh"]), "_calf": A.corrected_girth(_c(CALF), f["calf"]), "_arm": A.corrected_girth(_c(ARM), f["triceps"]),
        "_limbs": _known_sum(LIMBS), "_trunk": _known_sum(TRUNK), "_folds": _known_sum(FOLDS), "_n_folds": reduce(lambda a, b: a + b, (x.isNotNull().cast("int") for x in f.values())),
        "_dw": A.durnin_womersley(F.col("_sex"), F.col("_age"), f["triceps"], f["biceps"], f["subscapular"], f["suprailiac"]),
    }


def _second_stage() -> dict[str, Column]:
    return {"_free": _c(WEIGHT) - F.col("_fat")}


def _metrics():
    """``group, metric, unit, value, note``."""
    c, f = F.col, {k: _c(k) for k in FOLDS}
    weight, height, muscle, sedentary = _some(_c(WEIGHT)), c("_height"), _some(_c(MUSCLE)), _c(FAT_SEDENTARY)
    square = height * height
    comp, dist, ball = "composicao", "distribuicao", "futebol"
    yield comp, "% Massa Gorda (Atletas)", "%", c("_athlete"), c("_origin")
    yield comp, "Diferença Sedentários - Atletas", "pp", sedentary - c("_athlete"), ""
    yield comp, "% Massa Gorda (Faulkner)", "%", c("_faulkner"), ""
    yield comp, "% Massa Gorda (Yuhasz)", "%", A.yuhasz(*(f[k] for k in SIX)), ""
    yield comp, "% Massa Gorda (Petroski)", "%", A.petroski(c("_sex"), c("_age"), f["subscapular"], f["triceps"], f["suprailiac"], f["calf"]), ""
    yield comp, "Massa Gorda (Atletas)", "kg", weight * c("_athlete") / 100, ""
    yield comp, "Massa Isenta de Gordura (Atletas)", "kg", weight * (1 - c("_athlete") / 100), ""
    yield comp, "Massa Gorda", "kg", c("_fat"), ""
    yield comp, "Massa Isenta de Gordura", "kg", c("_free"), ""
    yield comp, "Coerência: MIG calculada - Massa Magra impressa", "kg", c("_free") - _some(_c(LEAN)), ""
    yield comp, "Índice de Massa Gorda (FMI)", "kg/m2", c("_fat") / square, ""
    yield comp, "Índice de Massa Isenta de Gordura (FFMI)", "kg/m2", A.fat_free_index(c("_free"), height), ""
    yield comp, "FFMI normalizado (1.80m)", "kg/m2", A.fat_free_index(c("_free"), height, normalised=True), ""
    yield comp, "Índice de Massa Muscular", "kg/m2", muscle / square, ""
    yield dist, "Rácio Cintura/Altura", "", _some(_c(WAIST)) / _some(_c(HEIGHT)), ""
    yield dist, "Rácio Cintura/Anca (recalculado)", "", _some(_c(WAIST)) / _some(_c(HIP)), ""
    yield dist, "Rácio Umbigo/Altura", "", _some(_c(NAVEL)) / _some(_c(HEIGHT)), ""
    yield dist, "Soma de Pregas (recalculada)", "mm", c("_folds"), c("_n_folds").cast("string")
    yield ball, F.concat(F.lit("Soma ISAK ("), c("_n_folds").cast("string"), F.lit(" de 8 sítios)")), "mm", c("_folds"), ""
    yield ball, "Soma 6 pregas (referência de atletas)", "mm", reduce(lambda a, b: a + b, (f[k] for k in SIX)), ""
    yield dist, "Soma pregas tronco", "mm", c("_trunk"), ""
    yield dist, "Soma pregas membros", "mm", c("_limbs"), ""
    yield dist, "Rácio Pregas Tronco/Membros", "", c("_trunk") / _some(c("_limbs")), ""
    yield comp, "% Massa Gorda (Durnin-Womersley)", "%", c("_dw"), ""
    yield comp, "Diferença entre métodos (%MG)", "pp", sedentary - c("_dw"), ""
    yield ball, "Perímetro Coxa corrigido", "cm", c("_thigh"), ""
    yield ball, "Perímetro Gémeo corrigido", "cm", c("_calf"), ""
    yield ball, "Perímetro Braço corrigido", "cm", c("_arm"), ""
    yield ball, "Área muscular estimada da coxa", "cm2", A.limb_area(_some(c("_thigh"))), ""
    yield ball, "Área muscular estimada do gémeo", "cm2", A.limb_area(_some(c("_calf"))), ""
    yield ball, "Coxa corrigida / peso", "cm/kg", _some(c("_thigh")) / weight, ""
    yield ball, "Massa Isenta de Gordura / Peso", "%", _some(c("_free")) / weight * 100, ""
    yield ball, "Índice alométrico de massa magra", "", _some(c("_free")) / F.pow(weight, F.lit(0.67)), ""
    yield ball, "Rácio Músculo/Gordura (recalculado)", "", muscle / _some(c("_fat")), ""
    yield ball, "Somatótipo - Endomorfia", "", A.endomorphy(f["triceps"], f["subscapular"], F.coalesce(f["supraspinale"], f["suprailiac"]), _some(_c(HEIGHT))), F.when(f["supraspinale"].isNull(), "suprailiac").otherwise("")
    yield ball, "Somatótipo - Ectomorfia", "", A.ectomorphy(_some(_c(HEIGHT)), weight), ""
    yield ball, "Área de Superfície Corporal (Du Bois)", "m2", A.surface_area(weight, _some(_c(HEIGHT))), ""


# Metrics that are better when they fall, and when they rise; all others have no direction.
LOWER = (
    "Massa Gorda", "Massa Gorda (Atletas)", "% Massa Gorda (Atletas)", "% Massa Gorda (Durnin-Womersley)", "% Massa Gorda (Faulkner)", "% Massa Gorda (Yuhasz)", "% Massa Gorda (Petroski)",
    "Percentagem Massa Gorda (Atletas)", "Percentagem Massa Gorda (Sedentários)", "Índice de Massa Gorda (FMI)", "Soma de Pregas", "Soma de Pregas (recalculada)", "Soma ISAK (8 de 8 sítios)", "Soma ISAK (7 de 8 sítios)",
    "Soma 6 pregas (referência de atletas)", "Soma pregas tronco", "Soma pregas membros", "Prega Cutânea Triciptal", "Prega Cutânea Bicipital", "Prega Cutânea Subescapular", "Prega Cutânea Supra-ilíaca",
    "Prega Cutânea Abdominal", "Prega cutânea Supraespinhal", "Prega Cutânea Coxa", "Prega Gêmeo", "Perímetro Cintura", "Perímetro Umbigo", "Rácio Cintura/Altura", "Rácio Umbigo/Altura", "Relação Cintura/Anca",
    "Rácio Cintura/Anca (recalculado)", "Somatótipo - Endomorfia",
)
HIGHER = (
    "Massa Isenta de Gordura", "Massa Isenta de Gordura (Atletas)", "Massa Isenta de Gordura / Peso", "Massa Magra", "Massa Muscular", "Índice de Massa Muscular", "Índice de Massa Isenta de Gordura (FFMI)",
    "FFMI normalizado (1.80m)", "Índice alométrico de massa magra", "Rácio Massa Muscular/Massa Gorda", "Rácio Músculo/Gordura (recalculado)", "Perímetro Coxa corrigido", "Perímetro Gémeo corrigido",
    "Perímetro Braço corrigido", "Área muscular estimada da coxa", "Área muscular estimada do gémeo", "Coxa corrigida / peso",
)
# Families by name, then by how the name starts; the rest is composition.
FAMILY_OF = {
    "Peso": "Composição", "Altura": "Composição", "Índice de massa corporal": "Índices", "FFMI normalizado (1.80m)": "Índices", "Índice alométrico de massa magra": "Índices", "Coxa corrigida / peso": "Rácios",
    "Massa Isenta de Gordura / Peso": "Rácios", "Relação Cintura/Anca": "Rácios", "Área de Superfície Corporal (Du Bois)": "Áreas musculares",
}
FAMILY_STARTS = {
    "Coerência": "Verificações", "Diferença": "Verificações", "Somatótipo": "Somatótipo", "Área": "Áreas musculares", "Prega": "Pregas", "Soma": "Pregas", "Perímetro": "Perímetros", "Rácio": "Rácios",
    "Relação": "Rácios", "Índice": "Índices",
}


def direction(metric: Column) -> Column:
    return F.when(metric.isin(*LOWER), "down").when(metric.isin(*HIGHER), "up").otherwise("neutral")


def family(metric: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in FAMILY_OF.items() for x in pair))[metric]
    begins = [F.when(metric.startswith(start), name) for start, name in FAMILY_STARTS.items()]
    return F.coalesce(known, *begins, F.lit("Composição"))


def legend(metrics: DataFrame) -> DataFrame:
    """``metric, direction, family`` of each distinct metric of ``metrics(metric)``: what is there to choose from, and how to read it."""
    m = F.col("metric")
    return metrics.select("metric").filter(m.isNotNull()).distinct().select("metric", direction(m).alias("direction"), family(m).alias("family"))
