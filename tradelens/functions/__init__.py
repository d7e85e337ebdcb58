"""Column expressions: period predicates, sign rules, guarded ratios, layout widths."""
