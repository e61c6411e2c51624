"""tessel: sparse-matrix and graph analytics expressed as Spark DataFrame programs."""
