"""User-facing knobs of an audit."""

from __future__ import annotations

from dataclasses import dataclass

from glossaudit.fixed_values import DEFAULT_BATCH_SIZE, DEFAULT_CONFIDENCE, DEFAULT_MIN_LENGTH


@dataclass(frozen=True)
class AuditParams:
    """Parameters shared by the batch, resumable and streaming audits.

    ``offset`` and ``limit`` slice the ordered URL list; 0 means "from the start" and "no limit".
    ``strict`` drops pages whose HTTP status is 400 or above; otherwise they are analysed.
    ``temperature`` divides the log-probabilities before they become shares: above 1 less is certain. None: the model's own.
    ``prune_skipped`` also drops everything *inside* skipped tags (off: only the tag itself).
    """

    min_length: int = DEFAULT_MIN_LENGTH
    confidence: float = DEFAULT_CONFIDENCE
    offset: int = 0
    limit: int = 0
    batch_size: int = DEFAULT_BATCH_SIZE
    strict: bool = False
    prune_skipped: bool = False
    temperature: float | None = None
