"""kinetrace: preparing and evaluating time-stamped trajectory data on Spark."""
