"""Candidate-job matching analytics on Spark."""
