"""Run options."""

from __future__ import annotations

from dataclasses import dataclass

#: Ranks of a result page.
RANKS = 10
#: Names by model number.
MODELS = ("pbm", "ccm", "dbn", "ubm")
#: Placement policies by number; Spark places work itself, so all of them mean a hash by query.
POLICIES = ("round-robin", "maximum utilisation", "memory", "compute capability", "cores", "peak performance")


@dataclass(frozen=True)
class RunOptions:
    """Options of a training run; unknown models, policies and shares are refused."""

    raw_path: str = "YandexRelPredChallenge100k.txt"
    output: str = ""
    max_sessions: int = 40_000
    iterations: int = 50
    model: str = "pbm"
    partition_type: int = 0
    test_share: float = 0.2
    job_id: int = 0

    def __post_init__(self):
        if self.model not in MODELS:
            raise ValueError(f"model is one of {MODELS}")
        if not 0 <= self.partition_type < len(POLICIES):
            raise ValueError(f"partition_type lies between 0 and {len(POLICIES) - 1}")
        if not 0 < self.test_share < 1:
            raise ValueError("test_share lies between 0 and 1")
        if self.iterations < 1 or self.max_sessions < -1:
            raise ValueError("iterations is positive, max_sessions is -1 or more")
