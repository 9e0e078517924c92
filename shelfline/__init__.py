"""Retail demand analytics as Spark DataFrame operators.

Invoice rows become a daily sales mart, leak-free features, baseline and boosted-tree
forecasts, forecast metrics, ABC/XYZ segments, a scenario inventory policy and a dashboard
table.  Every operator takes DataFrames and returns DataFrames.
"""
