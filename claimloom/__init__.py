"""Claim analytics on Spark: evolving statements in text as DataFrame views over an event table."""
