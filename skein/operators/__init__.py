"""operators of skein."""
