"""SQL oracles of the registered queries."""
