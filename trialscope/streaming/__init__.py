"""Streaming: intentionally empty.

The reference has no streams, watermarks, time windows or state (SURVEY 2J), so no
Structured Streaming operator is built.  The cleaning operators in
``trialscope.operators.clean`` are stateless column expressions and apply unchanged
to a streaming DataFrame from ``spark.readStream``.
"""
