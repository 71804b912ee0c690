from flowscore.sources.tables import read_table  # noqa: F401
