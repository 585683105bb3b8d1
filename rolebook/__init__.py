"""rolebook: job-posting and application analytics as plain PySpark jobs.

Operators take and return DataFrames (or Columns). Nothing here reads the
clock: every time-dependent operator takes an explicit ``as_of`` date.
"""
