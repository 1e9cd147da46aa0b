"""Training-data operators: ten independent modules, one per operator, and their registered queries."""
