"""Spectral, radar and scalar functions as Column expressions, all inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def _normalised(a: Column, b: Column) -> Column:
    return (a - b) / (a + b + EPS)


def ndvi(nir: Column, red: Column) -> Column:
    return _normalised(nir, red)


def evi(nir: Column, red: Column, blue: Column) -> Column:
    return F.lit(2.5) * (nir - red) / (nir + F.lit(6) * red - F.lit(7.5) * blue + F.lit(1) + EPS)


def ndwi(nir: Column, swir1: Column) -> Column:
    return _normalised(nir, swir1)


def cri(green: Column, re1: Column) -> Column:
    return F.lit(1.0) / (green + EPS) - F.lit(1.0) / (re1 + EPS)


def rendvi(nir: Column, re1: Column) -> Column:
    return _normalised(nir, re1)


def nbr(nir: Column, swir2: Column) -> Column:
    return _normalised(nir, swir2)


def all_indices(variant: str = "features") -> dict[str, Column]:
    """The six indices over columns B02 .. B12. variant "ts_long" has the other definitions of three of them."""
    b = {k: F.col(k) for k in ("B02", "B03", "B04", "B05", "B06", "B08", "B11", "B12")}
    out = {"NDVI": ndvi(b["B08"], b["B04"]), "EVI": evi(b["B08"], b["B04"], b["B02"]), "NBR": nbr(b["B08"], b["B12"])}
    if variant == "ts_long":
        return out | {"NDWI": _normalised(b["B03"], b["B08"]), "CRI": cri(b["B02"], b["B03"]), "RENDVI": _normalised(b["B06"], b["B05"])}
    if variant != "features":
        raise ValueError(f"unknown variant {variant!r}")
    return out | {"NDWI": ndwi(b["B08"], b["B11"]), "CRI": cri(b["B03"], b["B05"]), "RENDVI": rendvi(b["B08"], b["B05"])}


def radar_indices(vv: Column, vh: Column) -> dict[str, Column]:
    """Ratio, radar vegetation index and degradation index of backscatter in dB."""
    p, q = F.pow(F.lit(10.0), vv / 10), F.pow(F.lit(10.0), vh / 10)
    return {"ratio": vv - vh, "RVI": F.lit(4) * q / (p + q), "RFDI": (p - q) / (p + q)}


def to_db(power: Column) -> Column:
    """Decibels; null where there is no power."""
    return F.when(power > 0, F.lit(10.0) * F.log10(power))


def clear_sky(scl: Column) -> Column:
    """Scene classes vegetation, bare soil and water."""
    return F.coalesce(scl.isin(4, 5, 6), F.lit(False))


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def double_logistic(doy: Column, low: Column, high: Column, sos: Column, eos: Column, up: float = 0.08, down: float = 0.06) -> Column:
    return low + (high - low) * (F.lit(1) / (F.lit(1) + F.exp(-F.lit(up) * (doy - sos))) - F.lit(1) / (F.lit(1) + F.exp(-F.lit(down) * (doy - eos))))


def topographic_wetness(area: Column, tan_slope: Column, most: float = 20.0) -> Column:
    return F.least(F.lit(most), F.log(F.greatest(area, F.lit(1.0)) / F.greatest(tan_slope, F.lit(0.001))))


def softmax(scores: Column) -> Column:
    once = lambda x, f: F.transform(F.array(x), f)[0]  # f(x) with x evaluated once, not for each entry
    shares = lambda raised: once(F.aggregate(raised, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(raised, lambda x: x / total))
    return once(F.array_max(scores), lambda top: once(F.transform(scores, lambda x: F.exp(x - top)), shares))


def shannon(p: Column) -> Column:
    """Entropy over the natural logarithm of the number of classes, 0 to 1."""
    return F.aggregate(F.filter(p, lambda x: x > 0), F.lit(0.0), lambda s, x: s - x * F.ln(x)) / F.ln(F.size(p))


def argmax(p: Column) -> Column:
    """0-based index of the first greatest entry."""
    return F.array_position(p, F.array_max(p)) - 1


def presence(p: Column, least: float = 0.10) -> Column:
    return F.transform(p, lambda x: (x >= least).cast("int"))


def _ladder(x: Column, steps: list[tuple[float, str]], last: str) -> Column:
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for least, name in steps:
        out = out.when(x >= least, name)
    return out.otherwise(last)


def interpret_oa(x: Column) -> Column:
    return _ladder(x, [(0.90, "excellent"), (0.80, "very good"), (0.70, "good"), (0.60, "moderate"), (0.50, "weak")], "insufficient")


def interpret_kappa(x: Column) -> Column:
    return _ladder(x, [(0.81, "almost perfect"), (0.61, "strong"), (0.41, "moderate"), (0.21, "fair"), (0.0, "slight")], "none")


def interpret_f1(x: Column) -> Column:
    return _ladder(x, [(0.85, "very good"), (0.70, "good"), (0.55, "moderate")], "weak")


def aspect_parts(degrees: Column) -> dict[str, Column]:
    """An aspect as sine and cosine, so that 359 and 1 degrees are near."""
    return {"aspect_sin": F.sin(F.radians(degrees)), "aspect_cos": F.cos(F.radians(degrees))}


def decision_label(decision: Column) -> Column:
    """Shown names of the decisions of a feature selection."""
    return F.when(decision == "confirmed", "Confirmed").when(decision == "tentative", "Tentative").otherwise("Rejected")


def rounded(x: Column, digits: int) -> Column:
    """Half to even."""
    return F.bround(x, digits)


def overfit(train: Column, test: Column, gap: float = 0.03) -> Column:
    """Whether scores on training data are over `gap` above those on test data."""
    return (train - test) > gap
