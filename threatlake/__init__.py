"""threatlake: security-log analytics as lazy PySpark DataFrame functions."""
