"""rosterlake: record matching and analytics over messy career records, on PySpark."""
