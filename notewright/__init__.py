"""Claim-note entity intelligence on Spark."""
