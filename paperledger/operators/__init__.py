"""DataFrame operators of the reconciliation pipeline."""
