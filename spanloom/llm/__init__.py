"""Training-data operators: each module is one operator, its query is in ``queries``."""
