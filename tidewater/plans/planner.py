"""The one call that runs a policy by name."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewater.operators import signals
from tidewater.operators.engine import Config
from tidewater.operators.simulation import Simulation


def run_policy(panel: DataFrame, policy: str, config: Config = Config(), hot: DataFrame | None = None, **params) -> DataFrame:
    """The path of a policy over every symbol; see ``Simulation``."""
    return Simulation(signals.apply_policy(panel, policy, **params), config, hot=hot).path
