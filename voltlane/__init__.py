"""voltlane: EV-charging and road-travel analytics as plain PySpark DataFrame functions."""

__version__ = "0.1.0"
