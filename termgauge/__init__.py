"""Term-frequency and few-shot accuracy analytics as Spark DataFrame plans."""
