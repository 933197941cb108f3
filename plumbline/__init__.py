"""Calibration analytics on Spark: native column expressions, declared once and planned by Catalyst."""
