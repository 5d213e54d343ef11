"""Sources of snapmill."""
