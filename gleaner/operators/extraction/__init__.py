"""Main-content extraction of web pages as Spark jobs over a node table.

A page becomes rows of one table (page_id, pos, parent, last, …) in document
order.  ``pos … last`` is the interval of a subtree, so "inside a removed
subtree" is a running maximum and subtree totals are differences of running
sums.  All steps are windows over ``page_id``: after the first exchange no
step needs another one.  A group is one page, which already was one row.
"""
