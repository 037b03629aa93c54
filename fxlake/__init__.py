"""fxlake: interaction features, point-in-time training sets and candidate data on Spark."""
