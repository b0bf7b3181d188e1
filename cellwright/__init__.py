"""cellwright: find, combine, score and repair errors in table cells, on Spark."""
