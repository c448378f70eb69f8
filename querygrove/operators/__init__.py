"""Operators: graph building, expansion, selection, linking, text units, measures, calibration."""
