"""Table, recipe, XML and model-selection engine written for PySpark."""
