"""skein: hybrid search, data linking and feature preparation as Spark plans."""
