"""Typed errors of the read-pair engine."""

from __future__ import annotations


class MatewiseError(Exception):
    """Base of all errors raised by this package."""


class ConfigError(MatewiseError, ValueError):
    """A parameter that no read could be processed with."""


class InputError(MatewiseError):
    """A malformed record, or a file that can't be read."""


class PairingError(MatewiseError):
    """Mates that don't belong together, or files of different lengths."""


class StageError(MatewiseError):
    """A stage asked for where the pair isn't in the state for it."""


class ConversionError(MatewiseError):
    """A result that the caller's record type doesn't take."""


class RecordError(InputError):
    """A read whose sequence and qualities differ in length, are missing, or aren't bytes."""


class OverlapError(MatewiseError, ValueError):
    """An overlap out of its reads' range, or two that are equally good where ties are rejected."""


class ValidationError(MatewiseError):
    """An overlap that is too short to be informative, or has too many mismatches."""


class MergeError(MatewiseError):
    """Mates that differ with equal quality where that is rejected."""


class CorrectionError(MatewiseError):
    """A consensus whose bases and qualities don't fit together."""


class EvidenceError(MatewiseError):
    """Warehouse rows that break a key, a reference or a check."""


#: The error that a failed or rejected pair's reason stands for.
ERRORS: dict[str, type[MatewiseError]] = {
    "null_read": RecordError,
    "not_bytes": RecordError,
    "sequence_quality_length": RecordError,
    "overlap_tie": OverlapError,
    "k_exceeds_read": ValidationError,
    "insufficient_overlap_length": ValidationError,
    "excessive_mismatch_rate": ValidationError,
    "base_disagreement": MergeError,
}
