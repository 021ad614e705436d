"""Safety-signal detection over patient-generated text, as Spark plans."""
