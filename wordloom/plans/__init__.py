"""Plan helpers and the catalogue of registered queries."""
