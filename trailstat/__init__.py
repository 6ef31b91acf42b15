"""Trajectory analytics on Spark: episodes, cohorts, balanced comparison, linkage, catalog and checks."""
