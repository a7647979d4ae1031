"""skygrain: matching, gridding, profiling and modelling of irregular observations, written as Spark jobs."""
