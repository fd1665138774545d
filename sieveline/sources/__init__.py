"""Sources: readers with pruned columns, manifests, JSON lines with kept errors, idempotent table replacement."""
