"""Query plans over the record and report tables, each with the SQL of the same rows. Importing a module adds them to the catalogue."""
