"""Parameters of the bar strategy and of the audits."""

from __future__ import annotations

from dataclasses import dataclass

# Years whose trades count as in-sample and out-of-sample.
IN_SAMPLE = (2010, 2013, 2017, 2020, 2022, 2024, 2026)
OUT_OF_SAMPLE = (2011, 2012, 2014, 2015, 2016, 2018, 2019, 2021, 2023, 2025)


@dataclass(frozen=True)
class StrategyParams:
    # Fixed values of the frozen strategy.
    d: float = 0.45
    max_weights: int = 100
    weight_cutoff: float = 0.001
    z_window: int = 100
    z_threshold: float = 5.0
    ema_span: int = 60
    range_window: int = 60
    keltner_max: float = 11.462043356166953
    tick_size: float = 0.25
    target_r: float = 0.5
    cost_change_year: int = 2023
    cost_points: float = 1.0
    # Execution of the engine.
    block: int = 4_096

    @property
    def weights(self) -> list[float]:
        from barloom.functions.market import fracdiff_weights

        return fracdiff_weights(self.d, self.max_weights, self.weight_cutoff)

    @property
    def lookback(self) -> int:
        """Stored rows before a row that its features, and the previous row's z, depend on (EMA apart)."""
        return max(len(self.weights) + self.z_window, self.range_window) + 1


