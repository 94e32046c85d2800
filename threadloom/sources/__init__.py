"""Inputs: session logs and tables brought into the canonical frames."""
