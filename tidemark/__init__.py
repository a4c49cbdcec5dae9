"""Audience-risk analytics on Spark."""
