"""Readers and writers of document clusters, features, judgements, extracts and evaluation sets."""
