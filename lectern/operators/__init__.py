"""DataFrame-to-DataFrame operators of the summarization engine."""
