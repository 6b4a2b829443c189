"""Model-backed operators on Spark ML; any estimator can stand at the frame boundary."""
