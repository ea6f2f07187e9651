"""Part of notelake."""
