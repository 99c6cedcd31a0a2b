"""Whole plans: durable tables, the engine, its driver queries."""
