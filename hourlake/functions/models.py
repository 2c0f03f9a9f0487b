"""Labels and names around trained models."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def quality_label(r2: Column, rmse: Column, compat: bool = False) -> Column:
    """struct(quality_label, confidence_score).

    `compat` treats an rmse of exactly 0 as missing.
    """
    usable = rmse.isNotNull() & ~F.isnan(rmse) & (F.abs(rmse) != F.lit(float("inf")))
    if compat:
        usable = usable & (rmse != 0.0)
    pack = lambda name, conf: F.struct(
        F.lit(name).alias("quality_label"), F.lit(conf).alias("confidence_score")
    )
    r2 = F.when(~F.isnan(r2), r2)
    return (
        F.when(r2 >= 0.85, pack("excellent", 0.95))
        .when(r2 >= 0.65, pack("good", 0.8))
        .when((r2 >= 0.35) | usable, pack("usable", 0.6))
        .otherwise(pack("weak", 0.35))
    )


# fixed values: first hit in the lower-case model name decides
NAME_STATUS = [
    ("gbt", "trained_spark_gbt"),
    ("hist gradient", "trained_hist_gradient_boosting"),
    ("random forest", "trained_random_forest"),
    ("extra trees", "trained_extra_trees"),
    ("lstm", "trained_lstm"),
    ("gru", "trained_gru"),
    ("tft", "trained_tft"),
]


def model_status(name: Column, model_type: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    out = F.when(name.isNull() & model_type.isNull(), "insufficient_data")
    for part, status in NAME_STATUS:
        hit = n.contains(part)
        if part == "lstm":
            hit = hit & ~n.contains("cnn")
        out = out.when(hit, status)
    return out.when(model_type == "baseline", "fallback_naive").otherwise(
        F.concat(F.lit("trained_"), F.coalesce(model_type, F.lit("model")))
    )


def model_scope(mode: Column, model_location: Column, entity_location: Column) -> Column:
    """Location id of a per-location model, `global`, or `fallback` without a model."""
    return (
        F.when(mode.isNull(), "fallback")
        .when(mode == "per_location", F.coalesce(model_location, entity_location))
        .otherwise("global")
    )


def run_id(uri: Column) -> Column:
    """Run id of a `runs:/<id>/...` address, else NULL."""
    return F.nullif(F.regexp_extract(F.trim(F.coalesce(uri, F.lit(""))), r"^runs:/+([^/]+)", 1), F.lit(""))


def default_ids(df, unknown: str = "unknown", no_device: str = "meteostat_only"):
    """Missing place ids become `unknown`, missing devices the reference-only id."""
    fill = {"location_id": unknown, "province_id": unknown, "device_id": no_device}
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items() if c in df.columns})
