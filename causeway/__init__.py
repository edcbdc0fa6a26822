"""causeway: Spark operators for large histories of (change, item, outcome) rows."""
