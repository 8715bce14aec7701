"""Part of veilwork."""
