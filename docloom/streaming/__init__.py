"""Keeping the parsed tables up to date as documents arrive."""
