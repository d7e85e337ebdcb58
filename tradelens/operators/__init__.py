"""Reusable sub-plans: lookups, reductions, anti join, facts, stock, sales, chains."""
