"""DataFrame -> DataFrame operators (use with ``DataFrame.transform``)."""
