"""Functions of snapmill."""
