"""Training-data operators. Nothing else in the library imports this package; see queries.py for the registered queries."""
