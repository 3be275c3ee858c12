"""stakelens: grading, gating and point-in-time analysis of priced predictions on Spark."""
