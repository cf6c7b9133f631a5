"""Driver-table analogs and the registered queries."""
