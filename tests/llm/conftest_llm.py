"""Fixture rows for tests that compare with brute force."""

from importlib.util import module_from_spec, spec_from_file_location
from pathlib import Path

_spec = spec_from_file_location("llm_rows", Path(__file__).with_name("conftest.py"))
_rows = module_from_spec(_spec)
_spec.loader.exec_module(_rows)
DOCS, lower = _rows.DOCS, _rows.lower
