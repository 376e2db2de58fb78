"""Streams of results: batch jobs, live figures, state by user."""
