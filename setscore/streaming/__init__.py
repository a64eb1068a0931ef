"""Streaming entry points.

The analysis itself reads every input whole; it has no event time, windows,
late data or per-key state. The one event-driven loop in the reference is
the interactive report, which rescores on every gene-set upload.
``uploads.score_uploads`` re-expresses it as a file-source stream with
``foreachBatch`` scoring against a persisted matrix.
"""
