"""Photo grades from measured columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import at_least, at_most, clamp, col, half_even, megapixels
from ..functions.vectors import deviation, laplacian_variance, mean, percentile

# Weights of the composite grade.
COMPOSITE_WEIGHTS = {
    "resolution": 0.10, "sharpness": 0.20, "noise": 0.10, "compression": 0.05,
    "color": 0.10, "exposure": 0.15, "focus": 0.20, "distortion": 0.10,
}
# Weights of the other overall grades.
TECHNICAL_WEIGHTS = {"resolution": 0.25, "file_quality": 0.15, "sharpness": 0.40, "exposure": 0.20}
FACE_WEIGHTS = {"count": 0.20, "size": 0.35, "sharpness": 0.45}
SCAN_WEIGHTS = {"resolution": 0.10, "sharpness": 0.25, "exposure": 0.15, "face_size": 0.20, "face_sharpness": 0.30}


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    total = None
    for name, weight in weights.items():
        term = parts[name] * weight
        total = term if total is None else total + term
    return total


# Limits, levels and slopes of the piecewise scores, down to the combined grades.
def resolution_score(mp: Column) -> Column:
    return clamp(20 + mp * 10, 0, 100)


def resolution_bands(mp: Column) -> Column:
    """Video form."""
    return (
        F.when(mp >= 20, 100.0).when(mp >= 12, 90.0).when(mp >= 5, 70.0).when(mp >= 2, 50.0)
        .otherwise(at_least(mp / 0.5 * 20, 20))
    )


def exposure_score(brightness: Column) -> Column:
    """Piecewise: full between 80 and 180, floor outside [40, 230]."""
    return (
        F.when(brightness.between(80, 180), 100.0)
        .when((brightness < 40) | (brightness > 230), 20.0)
        .when(brightness < 80, 20 + (brightness - 40) * 2)
        .otherwise(20 + (230 - brightness) * 1.6)
    )


def contrast_adjustment(std: Column) -> Column:
    return F.when(std.between(30, 80), 0.0).when(std < 15, -15.0).when(std > 100, -10.0).otherwise(-5.0)


def exposure_bands(brightness: Column, std: Column) -> Column:
    """Video form."""
    light = (
        F.when((brightness < 60) | (brightness > 210), -30.0)
        .when((brightness < 80) | (brightness > 180), -10.0).otherwise(0.0)
    )
    spread = F.when(std < 20, -15.0).when(std > 90, -10.0).otherwise(0.0)
    return clamp(80 + light + spread, 0, 100)


def color_score(saturation: Column, p5: Column, p95: Column) -> Column:
    return at_most(saturation / 1.5, 100) * 0.4 + clamp((p95 - p5) / 2.0, 0, 100) * 0.6


def focus_score(center: Column, edge: Column) -> Column:
    bonus = F.when((edge > 0) & (center / F.greatest(edge, F.lit(1.0)) > 1.5), 5.0).otherwise(0.0)
    sharp = at_most(at_most(center / 8, 100) + bonus, 100)
    return F.when(center > 20, sharp).otherwise(at_least(center / 8 * 100, 0))


def aspect_score(width: Column, height: Column) -> Column:
    ratio = F.when(height > 0, width / height).otherwise(1.0)
    return F.when(ratio.between(0.6, 1.8), 100.0).when((ratio < 0.4) | (ratio > 3), 30.0).otherwise(65.0)


def distortion_score(width: Column, height: Column) -> Column:
    base = aspect_score(width, height)
    return F.when(F.least(width, height) < 500, F.greatest(base - 20, F.lit(0.0))).otherwise(base)


def photo_grade(video: bool = False) -> Column:
    """Struct of the eight grades, composite and blur score, one decimal each.

    Needs width, height, size_kb, sharpness_var, noise_std, mean_saturation, p5, p95, mean_brightness,
    brightness_std, center_var, edge_var (and kb_per_frame for videos).
    """
    c = F.col
    mp = megapixels(c("width"), c("height"))
    if video:
        per_mp = c("kb_per_frame") / F.greatest(mp, F.lit(0.1))
        parts = {
            "resolution": resolution_bands(mp),
            "exposure": exposure_bands(c("mean_brightness"), c("brightness_std")),
            "focus": at_most(c("center_var") / 8, 100),
            "distortion": F.lit(80.0),
        }
    else:
        per_mp = c("size_kb") / F.greatest(mp, F.lit(0.01))
        parts = {
            "resolution": resolution_score(mp),
            "exposure": clamp(exposure_score(c("mean_brightness")) + contrast_adjustment(c("brightness_std")), 0, 100),
            "focus": focus_score(c("center_var"), c("edge_var")),
            "distortion": distortion_score(c("width"), c("height")),
        }
    parts |= {
        "sharpness": clamp(c("sharpness_var") / 8, 0, 100),
        "noise": clamp(100 - c("noise_std") * 5, 0, 100),
        "compression": clamp(per_mp / 15, 0, 100),
        "color": color_score(c("mean_saturation"), c("p5"), c("p95")),
    }
    fields = [half_even(parts[n], 1).alias(n) for n in COMPOSITE_WEIGHTS]
    composite = half_even(weighted(parts, COMPOSITE_WEIGHTS), 1)
    return F.struct(*fields, composite.alias("composite"), half_even(c("sharpness_var"), 1).alias("blur_score"))


def technical_grade() -> Column:
    c = F.col
    mp = megapixels(c("width"), c("height"))
    parts = {
        "resolution": resolution_score(mp),
        "file_quality": clamp(c("size_kb") / F.greatest(mp, F.lit(0.01)) / 15, 0, 100),
        "sharpness": clamp(c("sharpness_var") / 8, 0, 100),
        "exposure": exposure_score(c("mean_brightness")),
    }
    return half_even(weighted(parts, TECHNICAL_WEIGHTS), 1)


def face_grade() -> Column:
    """Grade of the faces: number, size of the largest (share of the image) and its sharpness; 0 without faces."""
    c = F.col
    parts = {
        "count": F.least(c("face_count") * 30 + 40, F.lit(100)).cast("double"),
        "size": half_even(at_most(c("face_ratio") * 500, 100), 1),
        "sharpness": half_even(at_most(c("face_sharpness_var") / 5, 100), 1),
    }
    return F.when(c("face_count") > 0, half_even(weighted(parts, FACE_WEIGHTS), 1)).otherwise(0.0)


def recognition_score(distance: Column) -> Column:
    """0-100 from the smallest face distance to a person's references; 0 when no face was measured."""
    return half_even(F.coalesce(at_least((1 - distance / 0.8) * 100, 0), F.lit(0.0)), 1)


def composition_grade(center_x: Column, center_y: Column) -> Column:
    """Aspect ratio and centring of the main face (relative centre; null without a face)."""
    dx, dy = F.abs(center_x - 0.5), F.abs(center_y - 0.45)
    centred = half_even(at_least(100 - F.sqrt(dx * dx + dy * dy) * 200, 30), 1)
    aspect = aspect_score(F.col("width"), F.col("height"))
    return half_even(aspect * 0.3 + F.coalesce(centred, F.lit(50.0)) * 0.7, 1)


def overall_grade(technical: Column, face: Column, composition: Column, recognition: Column | None = None) -> Column:
    """Overall grade; the recognition weight is spread over the rest when there are no references."""
    plain = technical * 0.25 + face * 0.40 + composition * 0.35
    if recognition is None:
        return half_even(plain, 1)
    best = F.array_max(F.map_values(recognition))
    known = technical * 0.20 + face * 0.30 + best * 0.25 + composition * 0.25
    return half_even(F.when(F.size(recognition) > 0, known).otherwise(plain), 1)


def scan_grade() -> Column:
    c = F.col
    parts = {
        "resolution": resolution_score(megapixels(c("width"), c("height"))),
        "sharpness": clamp(c("sharpness_var") / 8, 0, 100),
        "exposure": exposure_score(c("mean_brightness")),
        "face_size": half_even(at_most(c("face_ratio") * 500, 100), 1),
        "face_sharpness": at_most(c("face_sharpness_var") / 5, 100),
    }
    return half_even(weighted(parts, SCAN_WEIGHTS), 1)


def grid_measures(grid: Column | str, width: int, height: int) -> dict[str, Column]:
    """Measures of a row-major luminance grid: mean, deviation, percentiles, Laplacian variance, centre and edges."""
    g = col(grid)
    inner_r, inner_c = range(1, height - 1), range(1, width - 1)
    qh, qw = height // 4, width // 4
    edge_rows = [r for r in inner_r if r < qh or r >= height - qh]
    return {
        "mean_brightness": mean(g),
        "brightness_std": deviation(g),
        "p5": percentile(g, 0.05),
        "p95": percentile(g, 0.95),
        "sharpness_var": laplacian_variance(g, width, inner_r, inner_c),
        "center_var": laplacian_variance(g, width, range(max(qh, 1), height - max(qh, 1)), range(max(qw, 1), width - max(qw, 1))),
        "edge_var": laplacian_variance(g, width, edge_rows, inner_c),
    }


def raw_quality(variant: str, width: str = "width", height: str = "height", size: str = "size_bytes") -> Column:
    """Quality without any measurement, by variant."""
    pixels = F.col(width).cast("double") * F.col(height)
    size_ = F.col(size).cast("double")

    def capped(full_pixels: float, full_bytes: float) -> Column:
        return at_most(pixels / full_pixels, 1) * 0.6 + at_most(size_ / full_bytes, 1) * 0.4

    # Saturation points of the two capped forms.
    forms = {
        "pixels_kb": pixels * (size_ / 1024),
        "pixels_bytes": pixels * size_,
        "capped_6mp": capped(3000 * 2000, 3 * 1024 * 1024),
        "capped_12mp": capped(4000 * 3000, 4 * 1024 * 1024),
        "pixels": pixels,
    }
    return forms[variant]
