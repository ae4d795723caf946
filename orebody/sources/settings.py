"""Settings of a run."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass


@dataclass
class RunConfig:
    source: str = ""
    output_dir: str = "./findings"
    sample_size: int = 0
    strategy: str = "random"
    seed: int = 42
    vector_name: str = ""
    vector_combine: bool = False
    epsilon: float = 0.3
    min_pts: int = 5
    reduce_to: int = 50
    reasoner: object | None = None
    incremental: bool = False
    trigger_interval: str = ""
    semantic_labels: bool = False
    payload: bool = False
    strict: bool = False
    topology_cap: int = 0

    def validate(self) -> RunConfig:
        if self.sample_size < 0:
            raise ValueError("sample_size must not be negative")
        if self.min_pts <= 0:
            raise ValueError("min_pts must be positive")
        if self.trigger_interval:
            interval_seconds(self.trigger_interval)
        return self

    def pool_size(self) -> int:
        """Rows to read before sampling: half as many again where the sample is to be diverse."""
        return self.sample_size * 3 // 2 if self.strategy == "diverse" else self.sample_size


def interval_seconds(text: str) -> float:
    """Seconds of a duration such as 90s, 5m or 1h30m; it must be positive."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|h|m|s)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    total = sum(float(n) * {"h": 3600, "m": 60, "s": 1, "ms": 0.001}[u] for n, u in parts)
    if total <= 0:
        raise ValueError("a duration must be positive")
    return total


def load_env(path: str) -> dict[str, str]:
    """Settings of a file of KEY=value lines into the environment, without replacing what is set."""
    added = {}
    if not os.path.exists(path):
        return added
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, eq, value = line.strip().partition("=")
            name, value = name.strip(), value.strip().strip("\"'")
            if eq and name and not name.startswith("#") and name not in os.environ:
                os.environ[name] = added[name] = value
    return added
