"""Building blocks that keep ordering, lookup and quantile work distributed."""
