"""Multi-round plans that the operators share."""
