"""Parameters of the stages.  All are frozen and checked when built."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace
from enum import Enum

import numpy as np

from .errors import ConfigError


class OverlapTie(str, Enum):
    """Which direction wins when both score alike."""

    REJECT = "reject"
    FROM_START = "from_start"
    FROM_END = "from_end"


class BaseTie(str, Enum):
    """What an overlap column becomes when both mates are equally sure of different bases."""

    FORWARD = "forward"
    REVERSE = "reverse"
    AMBIGUOUS = "ambiguous"
    REJECT = "reject"
    INTERIOR = "interior"


@dataclass(frozen=True)
class OverlapParams:
    max_differences: int = 5
    min_overlap: int = 10
    max_difference_share: float = 0.2
    min_comparisons: int = 10
    tie: OverlapTie = OverlapTie.FROM_START

    def __post_init__(self) -> None:
        if min(self.max_differences, self.min_overlap, self.min_comparisons) < 0:
            raise ConfigError("overlap parameters must not be negative")
        object.__setattr__(self, "tie", OverlapTie(self.tie))

    @property
    def share(self) -> float:
        """The share as 32-bit floating point, widened: thresholds are defined on that value."""
        return float(np.float32(self.max_difference_share))

    def allowed(self, length: int) -> int:
        """Differences allowed in an overlap of ``length`` bases."""
        scaled = length * self.share
        if not scaled > 0:
            return 0
        return self.max_differences if scaled >= self.max_differences else int(scaled)


@dataclass(frozen=True)
class ValidationPolicy:
    """Least complexity score, k-mer length, length floor, and allowed mismatches (expected * times + plus)."""

    score: int = 30
    k: int = 3
    floor: int = 5
    times: float = 8.0
    plus: float = 1.0

    def __post_init__(self) -> None:
        if self.k < 1:
            raise ConfigError("k must be at least 1")
        if self.score > 4**self.k:
            raise ConfigError(f"score {self.score} can't be reached with k-mers of {self.k}")

    @classmethod
    def loose(cls) -> ValidationPolicy:
        return cls(24, 3, 5, 10.0, 1.5)

    @classmethod
    def normal(cls) -> ValidationPolicy:
        return cls()

    @classmethod
    def strict(cls) -> ValidationPolicy:
        return cls(39, 3, 8, 6.0, 0.75)

    def with_score(self, score: int) -> ValidationPolicy:
        """Replace the score alone.  0 means 30; unusual values warn."""
        if score == 0:
            warnings.warn("a score of 0 is taken as 30", stacklevel=2)
            score = 30
        elif score > 55:
            warnings.warn("a score above 55 rejects nearly every overlap", stacklevel=2)
        elif score >= 45:
            warnings.warn("a score of 45 or more rejects many true overlaps", stacklevel=2)
        elif score < 21:
            warnings.warn("a score below 21 accepts repetitive overlaps", stacklevel=2)
        return replace(self, score=score)

    def with_k(self, k: int) -> ValidationPolicy:
        return replace(self, k=k)


@dataclass(frozen=True)
class MergeParams:
    tie: BaseTie = BaseTie.FORWARD

    def __post_init__(self) -> None:
        object.__setattr__(self, "tie", BaseTie(self.tie))


@dataclass(frozen=True)
class CorrectionParams:
    max_quality: int = 40
    quality_only: bool = False
    min_delta: int = 0

    def __post_init__(self) -> None:
        if not 0 <= self.max_quality <= 93 or self.min_delta < 0:
            raise ConfigError("max_quality must be 0 to 93 and min_delta not negative")


@dataclass(frozen=True)
class EngineConfig:
    """The whole chain.  ``validation`` or ``correction`` of None leaves that stage out."""

    overlap: OverlapParams = field(default_factory=OverlapParams)
    validation: ValidationPolicy | None = field(default_factory=ValidationPolicy)
    merge: MergeParams = field(default_factory=MergeParams)
    correction: CorrectionParams | None = field(default_factory=CorrectionParams)

    def steps(self) -> tuple[str, ...]:
        """Overlap, validate, merge, correct: what the batch job does."""
        out = ["overlap"]
        if self.validation is not None:
            out.append("validate")
        out.append("merge")
        if self.correction is not None:
            out.append("correct")
        return tuple(out)
