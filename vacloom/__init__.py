"""vacloom: hiring-evidence analytics as Spark DataFrame operators.

Every operator is a function from DataFrames to DataFrames. Nothing here plans,
schedules or stores by itself: plans are declared and Spark runs them.
"""
