"""Arrival-time models."""
