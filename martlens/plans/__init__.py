"""Star schema, audit and business reports."""
