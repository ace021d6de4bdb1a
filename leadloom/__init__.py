"""Evidence-based lead analytics as DataFrame-to-DataFrame functions."""
