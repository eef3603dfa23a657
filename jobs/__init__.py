"""Jobs that can be run from the command line; queries.py registers them."""
