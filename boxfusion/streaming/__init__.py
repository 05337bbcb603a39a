"""Streams of boxes.  Offline tracking needs whole scenes; what a stream can have is gate and
threshold, which are stateless, and a causal tracker, whose hit counts are those so far."""
