"""Durable storage: sorted runs, the edit log and its catalogue."""
