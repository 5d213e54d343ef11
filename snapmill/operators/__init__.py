"""Operators of snapmill."""
