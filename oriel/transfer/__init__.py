"""Moving tables: analysis, conversion by column, progress and results."""
