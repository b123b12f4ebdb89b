"""Column expressions shared by the operators; no Spark job runs here."""
