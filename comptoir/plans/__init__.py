"""Physical building blocks: ranks and running sums over groups of any size, quantiles, nearest matches."""
