"""DataFrame -> DataFrame operators that aggregate, join, sample or rank."""
