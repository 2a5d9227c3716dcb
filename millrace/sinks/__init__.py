"""Writers and report tables."""
