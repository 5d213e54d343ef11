"""Streaming of snapmill."""
