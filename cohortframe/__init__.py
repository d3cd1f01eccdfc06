"""DataFrame jobs over sequencing-cohort data."""
