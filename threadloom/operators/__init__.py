"""Operators over frames: fold, merge, grep, ranking and index freshness."""
