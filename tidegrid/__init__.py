"""Cleaning, feature building, day-ahead forecasting and scoring of many time
series at once, written as Spark DataFrame jobs."""
