"""Keyed state over streams of requests."""
