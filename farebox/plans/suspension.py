"""Line suspension: synthetic control on a normalised unit panel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farebox.operators import synth


@dataclass(frozen=True)
class Design:
    """Columns and dates of one study; the suspension includes both end dates."""

    unit: str
    t: str
    season: str
    treated: int
    start: str
    end: str
    last: str

    @property
    def before(self) -> Column:
        return F.col(self.t) < F.lit(self.start).cast("date")

    @property
    def during(self) -> Column:
        return F.col(self.t).between(F.lit(self.start).cast("date"), F.lit(self.end).cast("date"))

    @property
    def shown(self) -> Column:
        return F.col(self.t) <= F.lit(self.last).cast("date")


def normalised(panel: DataFrame, d: Design, value: str = "total") -> DataFrame:
    return synth.season_normalize(panel, d.before, d.unit, d.season, value).where(d.shown)


def weights(norm: DataFrame, d: Design, all_units: bool = False) -> DataFrame:
    """Donor weights of the treated unit, or of every unit in turn."""
    return synth.synthetic_control_weights(
        norm.where(d.before), d.unit, d.t, "norm", None if all_units else [d.treated]
    )


def gaps(norm: DataFrame, w: DataFrame, d: Design) -> DataFrame:
    return synth.synth_gap(norm, w, d.unit, d.t, "norm")


def randomisation_test(norm: DataFrame, w: DataFrame, d: Design) -> DataFrame:
    """Permutation test from the gaps of all units (``w`` holds weights of every unit)."""
    return synth.permutation_test(synth.rmspe_ratios(gaps(norm, w, d), d.before, d.during), d.treated)


def lost(norm: DataFrame, w: DataFrame, panel: DataFrame, d: Design, season_of: Column, value: str = "total") -> DataFrame:
    return synth.lost_demand(gaps(norm, w, d), panel, d.before, d.during, d.unit, d.season, season_of, value)
