"""Oracle-dialect SQL: tokens, syntax tree, parser and the writer of Spark SQL."""
