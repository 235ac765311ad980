"""Analytics over scientific tables and gridded data, as Spark plans."""
