"""Files and containers read into assets and their parts."""
