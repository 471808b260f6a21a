"""Scoring of change candidates: gates, types, confidence and queue rank, as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terratile.functions.columns import clip, geometric_mean


@dataclass(frozen=True)
class Config:
    """Thresholds (fixed values)."""

    max_bad: float = 0.05
    min_valid: float = 0.80
    trust_px: float = 0.30
    max_px: float = 0.50
    floor_weight: float = 0.35
    min_corr: float = 0.60
    low_corr_weight: float = 0.6
    ndvi_anomaly: float = 0.10
    ndbi_anomaly: float = 0.06
    ndwi_anomaly: float = 0.08
    min_area_px: int = 50
    ndbi_up: float = 0.05
    ndvi_down: float = -0.08
    ndvi_flat: float = 0.05
    ndwi_change: float = 0.15
    ndwi_least: float = 0.05
    road_elongation: float = 3.0
    road_ndbi_up: float = 0.03


def with_context(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidates joined to their pair's facts, with the anomalies against the scene's deltas."""
    joined = candidates.join(pairs, "pair_id")
    return joined.withColumns({f"{x}_anomaly": F.col(f"d_{x}") - F.col(f"scene_d_{x}") for x in ("ndvi", "ndbi", "ndwi")})


def registration_weight(residual: Column, cfg: Config = Config()) -> Column:
    between = 1.0 - (residual - cfg.trust_px) / (cfg.max_px - cfg.trust_px) * (1.0 - cfg.floor_weight)
    return F.when(residual <= cfg.trust_px, 1.0).when(residual >= cfg.max_px, cfg.floor_weight).otherwise(between)


def gates(rows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Adds ``trace`` (all five outcomes in order), ``suppressed_by`` (the first that suppresses) and ``downweight``."""
    bad = F.greatest("bad_earlier", "bad_later")
    quality = (bad <= cfg.max_bad) & (F.col("valid_fraction") >= cfg.min_valid)
    seasonal = (
        (F.abs("ndvi_anomaly") <= cfg.ndvi_anomaly) & (F.abs("ndbi_anomaly") <= cfg.ndbi_anomaly) & (F.abs("ndwi_anomaly") <= cfg.ndwi_anomaly)
    )
    low = F.col("min_corr") < cfg.min_corr
    one = F.lit(1.0)

    def outcome(rule: str, passes: Column, fails: str, weight: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.when(passes, "pass").otherwise(fails).alias("verdict"), weight.alias("weight"))

    trace = F.array(
        outcome("quality", quality, "suppress", one),
        outcome("registration", F.col("residual_px") <= cfg.trust_px, "downweight", registration_weight(F.col("residual_px"), cfg)),
        outcome("radiometric", ~low, "downweight", F.when(low, cfg.low_corr_weight).otherwise(1.0)),
        outcome("phenology", ~seasonal, "suppress", one),
        outcome("morphology", F.col("area_px") >= cfg.min_area_px, "suppress", one),
    )
    rows = rows.withColumn("trace", trace)
    first = F.get(F.filter("trace", lambda t: t["verdict"] == "suppress"), F.lit(0))["rule"]
    return rows.withColumn("suppressed_by", first).withColumn("downweight", F.aggregate("trace", one, lambda a, t: a * t["weight"]))


def change_type(cfg: Config = Config()) -> Column:
    """Ordered rules: water, road, construction, clearance, other."""
    nv, nb, nw, raw = F.col("ndvi_anomaly"), F.col("ndbi_anomaly"), F.col("ndwi_anomaly"), F.col("d_ndwi")
    return (
        F.when((nw >= cfg.ndwi_change) & (raw >= cfg.ndwi_least), "water_gain")
        .when((nw <= -cfg.ndwi_change) & (raw <= -cfg.ndwi_least) & (nv <= cfg.ndvi_flat), "water_loss")
        .when((F.col("elongation") >= cfg.road_elongation) & (nb >= cfg.road_ndbi_up), "road")
        .when((nb >= cfg.ndbi_up) & (nv <= cfg.ndvi_flat), "construction")
        .when((nv <= cfg.ndvi_down) & (F.abs(nb) < cfg.ndbi_up), "clearance")
        .otherwise("other")
    )


def spectral_agreement(cfg: Config = Config()) -> Column:
    """How far past its threshold the anomaly that drives the type lies."""

    def ramp(x: Column, low: float, high: float) -> Column:
        return clip((x - low) / (high - low), 0.0, 1.0)

    kind = F.col("change_type")
    water = 0.4 + 0.6 * ramp(F.abs("ndwi_anomaly"), cfg.ndwi_change, cfg.ndwi_change + 0.25)
    return (
        F.when(kind.isin("water_gain", "water_loss"), water)
        .when(kind == "construction", 0.35 + 0.65 * ramp(F.col("ndbi_anomaly"), cfg.ndbi_up, cfg.ndbi_up + 0.20))
        .when(kind == "road", 0.3 + 0.5 * ramp(F.col("ndbi_anomaly"), 0.0, cfg.ndbi_up + 0.15))
        .when(kind == "clearance", 0.35 + 0.65 * ramp(-F.col("ndvi_anomaly"), -cfg.ndvi_down, -cfg.ndvi_down + 0.20))
        .otherwise(0.35)
    )


def sar_factor() -> Column:
    """Five levels by the change in decibels in the direction that the type leads one to expect."""
    kind = F.col("change_type")
    agree = (
        F.when(kind == "water_gain", -F.col("dvv_db"))
        .when(kind.isin("water_loss", "construction"), F.col("dvv_db"))
        .when(kind == "clearance", -F.col("dvh_db"))
    )
    return F.when(agree >= 3.0, 1.10).when(agree >= 1.0, 1.04).when(agree <= -3.0, 0.80).when(agree <= -1.0, 0.93).otherwise(1.0)


#: Area and anomaly terms of the significance are raised to this (fixed value).
LEAST_TERM = 0.10

#: Confidence and penalty by persistence class.
PERSISTENCE_CONFIDENCE = {"persistent": 0.95, "progressive": 0.85, "recent": 0.75, "transient": 0.20, "inconsistent": 0.15, "single_pair": 0.55, "none": 0.0}
PERSISTENCE_PENALTY = {"transient": 0.5, "inconsistent": 0.45, "single_pair": 0.85}


def by_key(key: Column, values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def confidence_terms(cfg: Config = Config()) -> list[tuple[str, Column, float]]:
    """(name, value, weight) of the six terms."""
    model = clip((F.col("mean_prob") - 0.50) / (0.97 - 0.50), 0.0, 1.0)
    quality = clip(F.least(F.col("valid_fraction"), 1.0 - F.greatest("bad_earlier", "bad_later") / cfg.max_bad), 0.0, 1.0)
    return [
        ("model", model, 2.0), ("persistence", by_key(F.col("persistence"), PERSISTENCE_CONFIDENCE, 0.0), 2.0), ("spectral", F.col("spectral"), 1.5), ("quality", quality, 1.5),
        ("registration", registration_weight(F.col("residual_px"), cfg), 1.0), ("radiometric", clip(F.col("reliability"), 0.0, 1.0), 1.0),
    ]


def confidence_multipliers() -> dict[str, Column]:
    """Gate weight, persistence penalty and radar factor."""
    return {"gates": clip(F.col("downweight"), 0.0, 1.0), "penalty": by_key(F.col("persistence"), PERSISTENCE_PENALTY, 1.0), "sar": clip(F.col("sar"), 0.5, 1.15)}


def confidence(cfg: Config = Config()) -> Column:
    """Weighted geometric mean of six terms, times gate weight, persistence penalty and radar factor."""
    mean = geometric_mean([(value, weight) for _, value, weight in confidence_terms(cfg)])
    gates_, penalty, radar = confidence_multipliers().values()
    return clip(mean * (gates_ * penalty) * radar, 0.0, 1.0)


def persistence_classes(rows: DataFrame, span: Column) -> DataFrame:
    """(candidate_id, persistence): the class of a candidate's consecutive pairs (``at``, ``flag``) and of ``span``, the first-to-last pair's flag as an aggregate.

    Only the number of pairs, the first one's flag and whether any later one
    is set count, so a candidate's pairs are summed where they lie.
    """
    of = rows.groupBy("candidate_id").agg(F.count("*").alias("n"), F.min_by("flag", "at").alias("early"), F.count_if("flag").alias("set"), span.alias("span"))
    span, early = F.col("span"), F.coalesce("early", F.lit(False))
    later = F.col("set") > early.cast("long")
    kind = (
        F.when(F.col("n") == 1, F.when(early, "single_pair").otherwise("none"))
        .when(~span & ~early & ~later, "none")
        .when(~span & early & later, "inconsistent")
        .when(~span, "transient")
        .when(early & later, "progressive")
        .when(early, "persistent")
        .when(later, "recent")
        .otherwise("transient")
    )
    return of.select("candidate_id", kind.alias("persistence"))


def suppression_summary(rows: DataFrame) -> DataFrame:
    """Per pair: raw, survived, down-weighted survivors, and how many each rule suppressed first."""
    by_rule = [F.count_if(F.col("suppressed_by") == r).alias(r) for r in ("quality", "phenology", "morphology")]
    alive = F.col("suppressed_by").isNull()
    return rows.groupBy("pair_id").agg(
        F.count("*").alias("raw"), F.count_if(alive).alias("survived"), F.count_if(alive & (F.col("downweight") < 1.0)).alias("downweighted"), *by_rule
    )


def significance() -> Column:
    """Log-area term ** 0.6 times anomaly term ** 0.4."""
    area = (F.log10(F.greatest("area_px", F.lit(1))) - F.log10(F.lit(50.0))) / (F.log10(F.lit(3000.0)) - F.log10(F.lit(50.0)))
    anomaly = F.greatest(F.abs("ndvi_anomaly"), F.abs("ndbi_anomaly"), F.abs("ndwi_anomaly")) / 0.5
    return F.pow(clip(area, LEAST_TERM, 1.0), F.lit(0.6)) * F.pow(clip(anomaly, LEAST_TERM, 1.0), F.lit(0.4))


def queue_score() -> Column:
    return F.pow(clip(F.col("confidence"), 1e-3, 1.0), F.lit(0.65)) * F.pow(F.col("significance"), F.lit(0.35))


def fusion_score(semantic: Column | None = None) -> Column:
    """Weighted geometric mean of confidence, significance and, with a query, its rescaled similarity."""
    terms = [(F.col("confidence"), 3.0), (F.col("significance"), 1.5)]
    return geometric_mean(terms if semantic is None else [*terms, (semantic, 2.0)])
