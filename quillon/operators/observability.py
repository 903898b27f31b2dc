"""Summaries of measurements, and a capacity model."""

from __future__ import annotations

import math
from dataclasses import dataclass

GB = 1 << 30


def percentile(sorted_values: list[float], p: float) -> float:
    """The nearest-rank percentile; 0 of nothing."""
    if not sorted_values:
        return 0.0
    return sorted_values[max(0, math.ceil(p / 100 * len(sorted_values)) - 1)]


def summarize(values: list[float]) -> dict[str, float]:
    v = sorted(values)
    out = {"count": len(v), "mean": sum(v) / len(v) if v else 0.0} | {f"p{p}": percentile(v, p) for p in (50, 90, 95, 99)}
    return out | {"max": v[-1] if v else 0.0, "tail": out["p99"] / out["p50"] if out["p50"] else 0.0}


@dataclass(frozen=True)
class Capacity:
    """The model's default assumptions."""

    documents: int = 50_000_000
    source_bytes: int = 1200
    overhead: float = 0.55
    replicas: int = 1
    merge: float = 1.2
    recovery: float = 1.1
    snapshot: float = 1.15
    months: int = 12
    growth: float = 0.04
    queries: float = 400
    cost_ms: float = 12
    cores: int = 8
    utilisation: float = 0.6
    ram_gb: int = 64
    hot: float = 0.3
    disk_gb: int = 1000

    def plan(self) -> dict:
        logical = self.documents * self.source_bytes * (1 + self.overhead)
        stored = logical * (1 + self.replicas) * self.merge * self.recovery * self.snapshot * (1 + self.growth) ** self.months
        nodes = {
            "for_storage": math.ceil(stored / (self.disk_gb * GB)),
            "for_cpu": math.ceil(self.queries * self.cost_ms / 1000 / max(0.001, self.cores * self.utilisation)),
            "for_ram": math.ceil(stored * self.hot / max(1, self.ram_gb * GB * 0.5)),
        }
        most = max(1, *nodes.values())
        binding = next((k.removeprefix("for_") for k, n in nodes.items() if n == most), "storage")
        return nodes | {"bytes": stored, "nodes": most, "binding": binding}


UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def format_bytes(size: float) -> str:
    """A size in the largest unit of which it has one, up to petabytes: three digits at most behind whole bytes."""
    unit = 0
    while size >= 1024 and unit < len(UNITS) - 1:
        size, unit = size / 1024, unit + 1
    return f"{size:.{0 if size >= 100 or not unit else 1}f} {UNITS[unit]}"
