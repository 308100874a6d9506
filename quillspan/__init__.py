"""quillspan: citation verification and training-data preparation on Spark."""
