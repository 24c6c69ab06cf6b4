"""DataFrame operators.

Two facts bound the work per task and are used throughout:

* The observation grain is (series, day). Duplicates are folded into that grain
  by aggregates that combine on the map side, so however many raw rows one
  series owns, its window partition never exceeds the number of calendar days
  (about 36,500 rows per century).
* Everything at a finer grain (operations, filings, events, order lines) is
  handled by aggregates and joins only, never by a window over a raw key.
"""
