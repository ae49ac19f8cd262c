"""Loss curves from training logs (M1)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def loss_points(states: DataFrame) -> DataFrame:
    """stage, file, pos, step, loss of each log entry whose step is a whole number and whose loss is a number.

    Entries are variants: a text, a truth value, null, a list or an object is neither, and a number with a point or an exponent
    isn't whole. A step beyond 64 bits has no row.
    """
    each = states.select("stage", "file", F.posexplode("log_history").alias("pos", "entry"))
    step, loss = (F.try_variant_get("entry", f"$.{k}", "variant") for k in ("step", "loss"))
    kinds = each.select("stage", "file", "pos", step.alias("_step"), loss.alias("_loss"))
    whole = F.schema_of_variant("_step") == "BIGINT"
    number = F.schema_of_variant("_loss").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return kinds.where(whole & number).select("stage", "file", "pos", F.try_variant_get("_step", "$", "long").alias("step"), F.try_variant_get("_loss", "$", "double").alias("loss")).where("step IS NOT NULL AND loss IS NOT NULL")


def loss_curve(points: DataFrame) -> DataFrame:
    """stage, step, loss: of several entries of a step the last one by file name and position counts."""
    return points.groupBy("stage", "step").agg(F.max_by("loss", F.struct("file", "pos")).alias("loss"))
