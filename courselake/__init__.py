"""Course-activity analytics as Spark jobs: landing, typing, checks, marts, snapshots, forecasts."""

__version__ = "0.1.0"
