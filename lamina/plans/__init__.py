"""Query plans over op logs and the catalogue of queries."""
