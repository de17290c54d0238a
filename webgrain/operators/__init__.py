"""DataFrame operators: ranking, de-duplication, merging, budgets, schedules, graphs and pages."""
