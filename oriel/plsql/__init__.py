"""PL/SQL: routines, packages, cursors, exceptions and triggers on the driver; their SQL stays set-based."""
