"""Analytics over the logs that language-model agents leave behind, as PySpark DataFrame programs."""
