"""Document retrieval and text-corpus analytics as Spark DataFrame transformations."""
