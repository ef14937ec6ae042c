"""quirelake: Spark-first analytics over spreadsheets, decks, documents and forms."""

__version__ = "0.1.0"
