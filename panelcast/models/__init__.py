"""Forecasting models. Training and prediction run on Spark; the driver only
sees statistics whose size depends on the number of features."""
