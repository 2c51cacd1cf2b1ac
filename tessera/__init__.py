"""tessera: a PySpark-native engine for document intake, verification, practice runs and practice analytics."""
