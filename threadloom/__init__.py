"""Spark-first analytics over agent and conversation transcripts."""
