"""Read-only SQL over the lake and the catalogue of registered queries."""
