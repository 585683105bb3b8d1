"""End-to-end plans, table bindings and the registered queries."""
