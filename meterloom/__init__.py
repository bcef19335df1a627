"""Load-profile and anomaly-score analytics expressed as Spark DataFrame jobs."""
