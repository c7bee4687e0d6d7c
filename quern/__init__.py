"""quern: record curation, browsing, moderation and publishing on Spark DataFrames."""

__version__ = "0.1.0"
