"""What changes a table: inserts, deletes, updates, layout and schema changes."""
