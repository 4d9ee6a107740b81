"""Operators on findings, audits and links."""
