"""Part of lexmill."""
