"""docgrid: a PySpark-native analytics engine for page-structured documents."""
