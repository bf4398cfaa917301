"""Event-time stream analytics on Spark: timestamp repair, gating, clock binding, scheduling and budgets as DataFrame plans."""
