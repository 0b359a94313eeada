"""Product and advertising performance reports as Spark DataFrame plans."""
