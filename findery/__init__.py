"""Site search and search-log analytics as Spark jobs.

Operators take and return DataFrames. Rules are small Python values that are compiled into column
expressions, so they travel with the plan instead of through a join.
"""
