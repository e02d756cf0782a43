"""No streaming job exists here: every source is a file or a snapshot.

The row-level operators (cleaning, filters, classification, rules without group statistics) hold no state and work
unchanged on a streaming DataFrame.
"""
