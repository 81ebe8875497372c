"""Learning-rate schedules, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_anneal(step: Column, total: int, high: float, low: float) -> Column:
    part = F.least(F.lit(1.0), step / F.lit(float(max(1, total))))
    return F.lit(low) + F.lit(0.5 * (high - low)) * (1 + F.cos(F.lit(math.pi) * part))


def inverse_decay(epoch: Column, rate: float, decay: float) -> Column:
    return F.lit(rate) / (1 + F.lit(decay) * epoch)


def warmup_steps(ratio: float, steps: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.lit(ratio) * steps).cast("long"))
