"""Point-in-time analytics for competition results, written for Spark."""
