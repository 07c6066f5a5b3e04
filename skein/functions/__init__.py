"""functions of skein."""
