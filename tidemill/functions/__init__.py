"""Shared column rules, durable staging and small numeric helpers."""
