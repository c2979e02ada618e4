"""Spark jobs that score ranked answers and decide where step-by-step reasoning pays for its tokens."""
