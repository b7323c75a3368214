"""Part of the skein engine."""
