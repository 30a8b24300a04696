"""Storage-metadata analytics on PySpark: accounting, faults, placement, namespace, replay and drift as DataFrame operators."""
