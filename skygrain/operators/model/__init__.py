"""Blocked evaluation, mean models and residual kriging. Data stays in Spark; the driver sees moments and fitted parameters."""
