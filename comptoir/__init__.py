"""Financial-control analytics for a lending and savings institution, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
