"""keelson: object-store audit and corpus processing expressed as Spark plans."""
