"""Reading and writing: tables, CSV intake, scratch tables, driver fixtures."""
