"""Version history, re-graining, fingerprints and comparison of datasets on Spark."""
