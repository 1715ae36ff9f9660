"""DataFrame operators beside the SQL front end: constraints, row counts, index advice."""
