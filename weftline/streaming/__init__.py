"""Deliveries as streams."""
