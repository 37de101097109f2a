"""Query catalog over the driver's tables."""
