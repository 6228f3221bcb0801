"""Reports: plain functions from DataFrames and an ``as_of`` time to a DataFrame.

Rules shared by all of them:

* windows have a lower border only, rows dated after ``as_of`` count;
* an order joined to its lines is counted once per line, as the reports define
  it; the plans reach the same figures from per-order line counts, so the
  repeated rows are never built;
* joins to a unique key come after aggregation wherever the figures allow it,
  so a hot key is collapsed before it is shuffled;
* no join carries a broadcast hint unless its row count is bounded by a limit;
  Spark broadcasts by measured size;
* every sort names its null order and ends in key columns, so a cut at the
  border of a top-k repeats.
"""
