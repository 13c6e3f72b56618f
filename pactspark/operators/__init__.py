"""Governance operators over DataFrames."""
