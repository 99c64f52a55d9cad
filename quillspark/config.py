"""Settings that operators take."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Chunking:
    """Budgets of a chunker, in tokens, and switches."""

    most_tokens: int = 300
    least_tokens: int = 50
    merge_short: bool = True
    split_prose: bool = True
    overlap_tokens: int = 50


SINGLE = Chunking(most_tokens=500)
BATCH = Chunking(most_tokens=300)
LAYOUT = Chunking(most_tokens=1024)
PAGES = Chunking(most_tokens=512)


@dataclass(frozen=True)
class Parity:
    """Where the established behaviour is odd: True keeps it."""

    accept_placeholder: bool = True
    empty_header_matches_first_entry: bool = False
    batch_contents_heading_only: bool = False
