"""Readers, writers and the synthetic calibration table."""
