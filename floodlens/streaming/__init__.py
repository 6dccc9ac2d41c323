"""Continuous versions of the detection analyses."""
