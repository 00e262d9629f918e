"""Scans of selection cuts for the best quality factor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumiray import constants as K
from lumiray.functions.angles import separation
from lumiray.functions.numeric import first_step_above
from lumiray.functions.statistics import quality_factor
from lumiray.operators.quality import on_cut
from lumiray.operators.stats import histogram

GAMMA, PROTON = "gamma", "proton"


def zenith_theta_square(df: DataFrame) -> DataFrame:
    """Adds ThetaSquare: squared separation of (Az, Ze) from the zenith."""
    theta = separation(F.col("Az"), 90 - F.col("Ze"), F.lit(0.0), F.lit(90.0))
    return df.withColumn("ThetaSquare", theta * theta)


def _scan(per_event: DataFrame, value: str, step: float, steps: int, power: int) -> DataFrame:
    """Events below every threshold i*step, from one histogram of the first threshold
    that lies above each event's value, summed up over the thresholds."""
    beyond = steps + 1
    index = F.least(F.coalesce(first_step_above(F.col(value), step, power), F.lit(beyond)), F.lit(beyond))
    counts = per_event.groupBy(index.cast("int").alias("i")).agg(
        F.count_if(F.col("class") == GAMMA).alias("g"), F.count_if(F.col("class") == PROTON).alias("p")
    )
    spine = per_event.sparkSession.range(beyond + 1).select(F.col("id").cast("int").alias("i"))
    full = spine.join(counts, "i", "left").fillna(0, ["g", "p"])
    # one row per threshold, so these windows have a fixed size
    upto = Window.partitionBy(F.lit(0)).orderBy("i")
    whole = Window.partitionBy(F.lit(0))
    summed = full.select(
        "i",
        F.sum("g").over(upto).alias("n_gamma"),
        F.sum("p").over(upto).alias("n_proton"),
        F.sum("g").over(whole).alias("gamma_total"),
        F.sum("p").over(whole).alias("proton_total"),
    ).filter(F.col("i") <= steps)
    q = quality_factor(*[F.col(c) for c in ("n_gamma", "gamma_total", "n_proton", "proton_total")])
    return summed.select("i", (F.col("i") * F.lit(step)).alias("cut"), "n_gamma", "n_proton", q.alias("Q"))


def max_distance_scan(df: DataFrame, upper: float = K.MAX_DISTANCE_SCAN_DEG, steps: int = K.SCAN_STEPS) -> DataFrame:
    """Quality factor of every cut on the event's largest image distance."""
    per_event = df.groupBy("class", "Event").agg(F.max("Distance").alias("v"))
    return _scan(per_event, "v", upper / steps, steps, 1)


def theta_scan(df: DataFrame, upper: float = K.THETA_SCAN_DEG, steps: int = K.SCAN_STEPS) -> DataFrame:
    """Quality factor of every cut on the direction's distance; needs ThetaSquare."""
    per_event = df.groupBy("class", "Event").agg(F.min("ThetaSquare").alias("v"))
    return _scan(per_event, "v", upper / steps, steps, 2)


def cut_comparison(df: DataFrame) -> DataFrame:
    """Events and quality factor without cuts, with either cut and with both."""
    # the distance cut holds on the row with the event's largest distance; of tied rows
    # the one nearest in direction decides about both cuts together
    lead = F.max(F.struct(F.col("Distance").alias("d"), (-F.col("ThetaSquare")).alias("t")))
    events = df.groupBy("class", "Event").agg(lead.alias("far"), F.min("ThetaSquare").alias("theta"))
    cuts = {
        "none": F.lit(True),
        "max_distance": F.col("far.d") < K.MAX_DISTANCE_CUT_DEG,
        "theta_square": F.col("theta") < K.THETA_CUT_DEG**2,
        "both": on_cut(F.col("far.d"), -F.col("far.t")),
    }
    flags = events.select("class", *[F.coalesce(c, F.lit(False)).cast("int").alias(k) for k, c in cuts.items()])
    totals = flags.groupBy().agg(
        *[
            F.sum(F.when(F.col("class") == c, F.col(k)).otherwise(0)).alias(f"{k}_{c}")
            for k in cuts
            for c in (GAMMA, PROTON)
        ]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("cut"),
                F.col(f"{k}_{GAMMA}").alias("n_gamma"),
                F.col(f"{k}_{PROTON}").alias("n_proton"),
                quality_factor(
                    F.col(f"{k}_{GAMMA}"), F.col(f"none_{GAMMA}"), F.col(f"{k}_{PROTON}"), F.col(f"none_{PROTON}")
                ).alias("Q"),
            )
            for k in cuts
        ]
    )
    return totals.select(F.explode(rows).alias("r")).select("r.*")


def theta_histogram(df: DataFrame, bins: int = 80) -> DataFrame:
    """Directions of the rows within the distance cut."""
    near = df.filter(F.col("MaxDistance") < K.MAX_DISTANCE_CUT_DEG).withColumn("theta", F.sqrt("ThetaSquare"))
    return histogram(near, "theta", 0.0, 1.0, bins, "class")


def distance_histogram(df: DataFrame, bins: int = 80) -> DataFrame:
    """Largest distances of the rows within the direction cut."""
    return histogram(df.filter(F.col("ThetaSquare") < K.THETA_CUT_DEG**2), "MaxDistance", 0.0, 4.0, bins, "class")
