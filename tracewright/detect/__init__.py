"""Detectors over message text."""
