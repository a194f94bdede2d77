"""The columns that models are fitted on: their dictionary, its groups, nested arms, projection by name, and control columns of noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.operators.constraints import ConstraintError

# Names of the model's columns in order, their groups and the lengths of the arms.
TABLE = (
    "elevation_mean", "slope_mean", "aspect_sin", "aspect_cos", "TRI_mean", "area", "shape_index", "preevent_inundation_fraction",
    "river_dist_m", "mainstream_dist_m", "drainage_density", "k2_ndvi_mean", "k2_ndvi_change", "k2_maxdaily_max", "k2_max30d_max",
    "k2_heavydays_sum", "k2_cumulative_mean", "ant_1m", "ant_3m", "ant_6m", "wet_season_frac", "cropland_frac", "builtup_frac",
    "lu_builtup_delta", "lu_cropland_delta", "lu_change_freq", "road_dist_m", "road_density", "road_major_dist_m", "road_local_dist_m",
    "preevent_max_abs_monthly_level_change", "preevent_wet_dry_transition_count", "ant_inund_days_1m", "ant_drawdown_3m",
    "soil_purple_frac", "litho_T2_frac", "litho_J2_frac", "litho_T1_frac",
)
AVAILABILITY = ("log1p_valid_pixels", "has_valid_pixels")
CHANNELS = ("elevation", "slope", "aspect_sin", "aspect_cos", "preevent_wet_fraction", "relative_preevent_level_p10", "relative_preevent_level_p50", "relative_preevent_level_p90")
STATISTICS = ("mean", "sd", "p10", "p50", "p90")
JOINT = ("wet_weighted_slope", "wet_weighted_aspect_sin", "wet_weighted_aspect_cos", "wet_slope_covariance")
GROUPS = {
    "terrain": ("elevation_mean", "slope_mean", "aspect_sin", "aspect_cos", "TRI_mean"),
    "geometry": ("area", "shape_index"),
    "hydrography": ("river_dist_m", "mainstream_dist_m", "drainage_density"),
    "vegetation": ("k2_ndvi_mean", "k2_ndvi_change"),
    "rainfall": ("k2_maxdaily_max", "k2_max30d_max", "k2_heavydays_sum", "k2_cumulative_mean", "ant_1m", "ant_3m", "ant_6m", "wet_season_frac"),
    "landuse": ("cropland_frac", "builtup_frac", "lu_builtup_delta", "lu_cropland_delta", "lu_change_freq"),
    "roads": ("road_dist_m", "road_density", "road_major_dist_m", "road_local_dist_m"),
    "water": ("preevent_inundation_fraction", "preevent_max_abs_monthly_level_change", "preevent_wet_dry_transition_count", "ant_inund_days_1m", "ant_drawdown_3m"),
    "geology_soil": ("soil_purple_frac", "litho_T2_frac", "litho_J2_frac", "litho_T1_frac"),
    "availability": AVAILABILITY,
}
ARMS = {"table40": 40, "means48": 48, "distribution80": 80, "stats84": 84}


def pixel_columns() -> list[str]:
    """Names of the pixel summary's columns, statistic by statistic, then the joint ones."""
    return [f"{s}_{c}" for s in STATISTICS for c in CHANNELS] + list(JOINT)


def feature_columns() -> list[str]:
    """All columns in the model's order."""
    return [*TABLE, *AVAILABILITY, *pixel_columns()]


def feature_dictionary(spark: SparkSession) -> DataFrame:
    """(column, feature, factor_group, representation) of every column of the model. Both families of names partition the columns."""
    group_of = {name: group for group, names in GROUPS.items() for name in names}
    rows = [(name, group_of[name], "table38") for name in TABLE] + [(name, group_of[name], "availability2") for name in AVAILABILITY]
    for s in STATISTICS:
        for place, channel in enumerate(CHANNELS):
            rows.append((f"{s}_{channel}", "terrain" if place < 4 else "water", "means8" if s == "mean" else "distribution32"))
    rows += [(name, "water_terrain_joint", "joint4") for name in JOINT]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "column int, feature string, factor_group string, representation string")


def arm_columns(arm: str) -> list[str]:
    """An arm is a prefix of the columns, so that each contains the one before."""
    return feature_columns()[: ARMS[arm]]


def projected(df: DataFrame, include: list[str] | None = None, exclude: list[str] = (), keys: list[str] = ()) -> DataFrame:
    """Keys, then the included columns (all, if none are named) but for the excluded ones; a name that df doesn't have is an error, as is one given twice."""
    known = set(df.columns)
    chosen = list(include) if include is not None else [c for c in df.columns if c not in keys]
    if unknown := sorted({*chosen, *exclude, *keys} - known):
        raise ConstraintError(f"no such columns: {unknown}")
    if len(set(chosen)) < len(chosen):
        raise ConstraintError("a column is named twice")
    return df.select(*[F.col(f"`{c}`") for c in [*keys, *[c for c in chosen if c not in exclude and c not in keys]]])


def with_dictionary(metrics: DataFrame, dictionary: DataFrame) -> DataFrame:
    """metrics (column, feature, ...) with group and representation, many rows to one. A metric of a column that the dictionary doesn't have under that feature is an error, as is a dictionary that repeats a column."""
    if dictionary.groupBy("column", "feature").count().where("count > 1").count():
        raise ConstraintError("the dictionary repeats a column")
    if n := metrics.join(dictionary, ["column", "feature"], "left_anti").count():
        raise ConstraintError(f"{n} metrics aren't in the dictionary")
    return metrics.join(F.broadcast(dictionary), ["column", "feature"])  # one row a column: few


def gaussian_columns(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """df with n columns gz1.. of standard normal noise, from two hash numbers of key each (Box and Muller), so that reruns and partitions agree."""
    draw = lambda part, i: (F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(part), F.lit(str(seed)), F.lit(str(i)), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    return df.withColumns({f"gz{i}": F.sqrt(-2 * F.log(draw("radius", i))) * F.cos(draw("angle", i) * 6.283185307179586) for i in range(1, n + 1)})


def mode_matrix(spark: SparkSession, modes: list[str], ratios: list[str], members: int, size: int) -> DataFrame:
    """(name, mode, ratio, estimators, balanced, size): one row for each mode, and for each mode that draws subsets one for each ratio. Plain modes run two estimators, the others one for each member."""
    rows = []
    for mode in modes:
        draws = mode in ("subsample", "balanced_subsample")
        estimators = 2 if mode in ("baseline", "balanced") else members
        for ratio in (ratios or [None]) if draws else [None]:
            name = f"{mode}_p{ratio.replace(':', '_n')}" if ratio else mode
            rows.append((name, mode, ratio, estimators, mode.startswith("balanced"), size if draws and not ratio else None))
    return spark.createDataFrame(rows, "name string, mode string, ratio string, estimators int, balanced boolean, size int")
