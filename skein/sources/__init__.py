"""sources of skein."""
