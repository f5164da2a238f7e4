"""Ready-made queries over the driver's tables."""
