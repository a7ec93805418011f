"""Permit, review, licence and seal analytics as Spark DataFrame jobs."""
