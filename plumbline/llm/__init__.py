"""Training-data operators. Nothing else in the package imports this subpackage.

Every operator takes DataFrames and column names, and reads only the columns it names, so other columns
(also those with clashing names) never matter. Python runs only inside Arrow batches on the executors.
"""
