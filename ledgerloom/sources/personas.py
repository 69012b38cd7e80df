"""Behaviour profiles of the ledger generator, as TOML files or presets."""

from __future__ import annotations

import math
import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path

from ..functions.scalars import ACTION_KINDS


@dataclass(frozen=True)
class Circadian:
    hourly_weights: tuple = (1.0,) * 24
    actions_per_active_hour: float = 2.0
    jitter: float = 0.35


@dataclass(frozen=True)
class Split:
    min_parts: int = 1
    max_parts: int = 1
    min_part_lamports: int = 1


@dataclass(frozen=True)
class Decoy:
    decoys_per_real: float = 0.0
    dust_lamports_max: int = 1


@dataclass(frozen=True)
class Persona:
    name: str
    wealth_tier: str
    base_amount_lamports: int
    num_subaccounts: int
    amount_sigma: float = 0.6
    action_weights: dict = field(default_factory=lambda: {"transfer": 1.0})
    circadian: Circadian = Circadian()
    split: Split = Split()
    decoy: Decoy = Decoy()

    def validate(self) -> Persona:
        weights, c, s, d = self.action_weights, self.circadian, self.split, self.decoy
        rules = (
            (self.name.strip(), "name is empty"),
            (self.wealth_tier.strip(), "wealth_tier is empty"),
            (self.base_amount_lamports > 0, "base_amount_lamports must be positive"),
            (math.isfinite(self.amount_sigma) and self.amount_sigma >= 0, "amount_sigma must be finite, not negative"),
            (self.num_subaccounts > 0, "num_subaccounts must be positive"),
            (len(c.hourly_weights) == 24, "hourly_weights needs 24 values"),
            (all(math.isfinite(w) and w >= 0 for w in c.hourly_weights), "hourly_weights must be finite, not negative"),
            (any(w > 0 for w in c.hourly_weights), "some hourly weight must be positive"),
            (math.isfinite(c.actions_per_active_hour) and c.actions_per_active_hour > 0, "actions_per_active_hour must be positive"),
            (0 <= c.jitter < 1, "jitter must lie in [0, 1)"),
            (1 <= s.min_parts <= s.max_parts, "split parts out of range"),
            (s.min_part_lamports > 0, "min_part_lamports must be positive"),
            (math.isfinite(d.decoys_per_real) and d.decoys_per_real >= 0 and d.dust_lamports_max > 0, "decoy out of range"),
            (set(weights) <= set(ACTION_KINDS), "unknown action kind"),
            (all(math.isfinite(w) and w >= 0 for w in weights.values()) and sum(weights.values()) > 0, "action weights must be finite, one above zero"),
        )
        for held, what in rules:
            if not held:
                raise ValueError(f"persona {self.name!r}: {what}")
        return self


def from_toml(text: str) -> Persona:
    raw = tomllib.loads(text)
    for key, kind in (("circadian", Circadian), ("split", Split), ("decoy", Decoy)):
        if key in raw:
            given = {k: tuple(v) if isinstance(v, list) else v for k, v in raw[key].items()}
            raw[key] = kind(**given)
    return Persona(**raw).validate()


def to_toml(persona: Persona) -> str:
    def show(v) -> str:
        if isinstance(v, str):
            return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
        return "[" + ", ".join(map(show, v)) + "]" if isinstance(v, (list, tuple)) else repr(v)

    flat = {k: v for k, v in asdict(persona).items() if not isinstance(v, dict)}
    lines = [f"{k} = {show(v)}" for k, v in flat.items()]
    for k, table in asdict(persona).items():
        if isinstance(table, dict):
            lines += ["", f"[{k}]", *(f"{x} = {show(y)}" for x, y in table.items())]
    return "\n".join(lines) + "\n"


def load_personas(paths: list[str]) -> list[Persona]:
    """The files, and the sorted ``*.toml`` of the folders, named; without any, the presets."""
    if not paths:
        return presets()
    files: list[Path] = []
    for p in map(Path, paths):
        found = sorted(p.glob("*.toml")) if p.is_dir() else [p]
        if not found:
            raise ValueError(f"no persona in {p}")
        files += found
    out = [from_toml(f.read_text()) for f in files]
    if len({p.name for p in out}) < len(out):
        raise ValueError("duplicate persona name")
    return out


def export_presets(folder: str) -> list[str]:
    Path(folder).mkdir(parents=True, exist_ok=True)
    written = []
    for p in presets():
        target = Path(folder, f"{p.name}.toml")
        target.write_text(to_toml(p))
        written.append(str(target))
    return written


def _hours(day: float, night: float) -> tuple:
    return tuple(day if 8 <= h < 23 else night for h in range(24))


def presets() -> list[Persona]:
    """Three profiles. Sizes, amounts, rates and action weights."""
    return [
        Persona("retail", "retail", 2_000_000, 4, 0.7, {"transfer": 0.55, "swap": 0.25, "stake": 0.10, "memo": 0.10},
                Circadian(_hours(1.0, 0.15), 2.0, 0.35), Split(2, 4, 50_000), Decoy(1.0, 30_000)),
        Persona("whale", "whale", 500_000_000, 8, 0.5, {"swap": 0.40, "transfer": 0.30, "stake": 0.20, "memo": 0.10},
                Circadian(_hours(0.9, 0.3), 2.0, 0.35), Split(3, 6, 1_000_000), Decoy(2.0, 200_000)),
        Persona("market_maker", "institution", 50_000_000, 6, 0.4, {"swap": 0.60, "transfer": 0.30, "memo": 0.10},
                Circadian((0.6,) * 24, 5.0, 0.25), Split(2, 5, 500_000), Decoy(2.5, 100_000)),
    ]
