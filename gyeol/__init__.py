"""gyeol: structured-disclosure analytics expressed as Spark plans."""
