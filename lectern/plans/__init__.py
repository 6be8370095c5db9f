"""Composed plans: the summarizer, parameter sweeps."""
