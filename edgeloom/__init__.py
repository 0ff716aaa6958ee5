"""Analytics over single-cell spatial edge lists, as lazily planned DataFrames."""
