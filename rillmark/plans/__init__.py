"""Planning: candidates, budgets and graphs as tables."""
