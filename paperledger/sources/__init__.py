"""Sources, sinks and ports."""
