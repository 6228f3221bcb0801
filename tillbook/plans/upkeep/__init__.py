"""Write jobs. Each takes table versions and a table of requests and returns the
next versions or the rows to append; nothing is written in place.

The service handles one key per call. Here a request table drives many keys at
once, and several requests for one key are added up first. Where a request sets
a value instead of adding to it, the one with the highest ``request_no`` counts; a
table without that column must have equal requests for a key, or the job fails.
"""
