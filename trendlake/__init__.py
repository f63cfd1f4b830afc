"""Analytics over items from many noisy sources, as functions from DataFrames to DataFrames."""
