"""Features of unevenly sampled time series on Spark, declared as specs and planned as one shuffle per object."""
