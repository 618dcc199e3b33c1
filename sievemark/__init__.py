"""sievemark: personal-data exposure analytics as Spark DataFrame plans."""
