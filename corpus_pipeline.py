"""Corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, byte-level BPE."""

from __future__ import annotations

from cellgauge.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
