"""Knobs of the linkage analysis, as immutable values."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class LinkConfig:
    """Which linking rules run, and their thresholds."""

    use_fee_payer: bool = True
    use_cospend: bool = True
    use_temporal_amount: bool = True
    temporal_window_secs: int = 120
    amount_tolerance_bps: int = 50
    use_activation_lineage: bool = True
    activation_window_secs: int = 172_800
    use_burst_copay: bool = True
    copay_min_sources: int = 2
    copay_min_shared_buckets: int = 2
    copay_min_amount: int = 0
    use_burst_coactivity: bool = True
    coactivity_min_shared_bursts: int = 3
    burst_max_sources: int = 10
    use_burst_union_ceiling: bool = False
    use_windowed: bool = False
    window_secs: int = 120
    use_funder_graph: bool = False
    funder_min_fundees: int = 3
    funder_max_sources: int = 100_000

    @classmethod
    def exact_ts(cls) -> LinkConfig:
        return cls()

    @classmethod
    def windowed(cls, window_secs: int) -> LinkConfig:
        return cls(
            use_windowed=True, window_secs=window_secs, use_burst_coactivity=False, copay_min_shared_buckets=3
        )

    @classmethod
    def funder_aware(cls, window_secs: int) -> LinkConfig:
        return replace(cls.windowed(window_secs), use_funder_graph=True)

    @classmethod
    def nothing(cls) -> LinkConfig:
        """Every rule off; enable single ones with ``dataclasses.replace``."""
        return cls(
            use_fee_payer=False,
            use_cospend=False,
            use_temporal_amount=False,
            use_activation_lineage=False,
            use_burst_copay=False,
            use_burst_coactivity=False,
        )

    @property
    def scoring_window(self) -> int:
        return self.window_secs if self.use_windowed else 0


@dataclass(frozen=True)
class LearnConfig:
    """The learned linker."""

    folds: int = 5
    iterations: int = 300
    learning_rate: float = 0.3
    l2: float = 1e-3
    threshold: float = 0.5
    copay_window_secs: int = 120
    peel_window_secs: int = 120
    activation_window_secs: int = 172_800
    amount_tolerance_bps: int = 50
    min_operators: int = 6
    min_positives: int = 20
