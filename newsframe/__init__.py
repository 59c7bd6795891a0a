"""newsframe: cleaning, statistics, features and classifiers for labelled text, as Spark DataFrame jobs."""

__version__ = "0.1.0"
