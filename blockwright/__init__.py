"""Block-based rate-distortion analytics on Spark."""
