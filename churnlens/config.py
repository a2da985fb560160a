"""Every tunable, with its default; environment variables ``CHURNLENS_<GROUP>__<FIELD>`` override them as JSON."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class BugfixDetection:
    # Words that mark a fix, and the pattern of a verb with an issue reference.
    keywords: tuple[str, ...] = ("fix", "fixes", "fixed", "fixing", "bug", "bugs", "bugfix", "patch", "hotfix", "defect", "regression", "crash", "broken")
    issue_pattern: str = r"\b(?:clos(?:e|es|ed)|resolv(?:e|es|ed)|fix(?:es|ed)?)\b[^\n]{0,24}?(?:#|\b[A-Z][A-Z0-9]+-)\d+"

    @property
    def keyword_pattern(self) -> str:
        return r"(?i)\b(?:" + "|".join(self.keywords) + r")\b"


@dataclass(frozen=True)
class Distribution:
    enabled: bool = True
    hot: float = 0.75
    very_hot: float = 0.90
    churn: float = 0.90
    min_files: int = 20


@dataclass(frozen=True)
class RiskWeights:
    file_large_lines: int = 300
    file_large_points: int = 25
    file_moderate_lines: int = 80
    file_moderate_points: int = 12
    very_hot_bugfixes: int = 8
    very_hot_points: int = 35
    hot_bugfixes: int = 3
    hot_points: int = 20
    churn_commits: int = 25
    churn_points: int = 10
    no_test_file_points: int = 20
    stale_test_points: int = 10
    very_high_ccn: int = 20
    very_high_ccn_points: int = 22
    high_ccn: int = 10
    high_ccn_points: int = 12
    new_to_file_points: int = 15
    low_ownership: float = 0.25
    low_ownership_points: int = 8
    broad_files: int = 10
    broad_files_points: int = 10
    broad_lines: int = 600
    broad_lines_points: int = 10
    weekend_points: int = 10
    late_night_points: int = 12
    late_night_start_hour: int = 22
    late_night_end_hour: int = 6
    medium_band_score: int = 35
    high_band_score: int = 65
    max_score: int = 100


@dataclass(frozen=True)
class Blast:
    enabled: bool = True
    max_depth: int = 3
    listed: int = 12
    hub: int = 20
    analyzed: int = 40
    max_files: int = 5000
    max_bytes: int = 400_000


@dataclass(frozen=True)
class Training:
    max_commits: int = 1500
    train_fraction: float = 0.75
    holdout_fraction: float = 0.85
    max_rounds: int = 300
    patience: int = 30
    depth: int = 3
    step: float = 0.05
    min_leaf: int = 30
    top_contributions: int = 6
    seed: int = 42


@dataclass(frozen=True)
class Settings:
    bugfix: BugfixDetection = field(default_factory=BugfixDetection)
    distribution: Distribution = field(default_factory=Distribution)
    weights: RiskWeights = field(default_factory=RiskWeights)
    blast: Blast = field(default_factory=Blast)
    training: Training = field(default_factory=Training)

    @classmethod
    def from_env(cls, env=None) -> Settings:
        env, made = os.environ if env is None else env, cls()
        for group in fields(cls):
            part, changes = getattr(made, group.name), {}
            for f in fields(part):
                raw = env.get(f"CHURNLENS_{group.name}__{f.name}".upper())
                if raw is not None:
                    value = json.loads(raw)
                    changes[f.name] = tuple(value) if isinstance(value, list) else value
            made = replace(made, **{group.name: replace(part, **changes)})
        return made
