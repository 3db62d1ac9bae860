"""Empty on purpose: the workload is batch only.

``operators.merge`` and ``operators.quality`` are pure DataFrame functions, so a caller with a
stream can use them inside ``foreachBatch`` as they are.
"""
