"""DataFrame operators: align, staging, snapshot, profile, prep, score, models."""
