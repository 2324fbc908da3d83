"""Streaming.

The reference has no streaming: every dataset is read whole before use, with no
watermark, event-time window or state.  Nothing is built here on purpose; the
batch operators are plain DataFrame functions, so they also run inside a
``foreachBatch`` of a user's own stream without change.
"""
