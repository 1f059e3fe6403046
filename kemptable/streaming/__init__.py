"""Profiles and the quality gate on Structured Streaming."""
