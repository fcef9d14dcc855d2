"""Structured Streaming forms: live curation (T1), live novelty (T2), in-stream de-dup
of verified files (T3), incremental index maintenance (T4); restart comes from each
query's checkpoint location (T5)."""
