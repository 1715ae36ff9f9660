"""oriel: a Spark-first engine for Oracle-dialect SQL, PL/SQL and table transfer."""
