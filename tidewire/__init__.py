"""tidewire: DataFrame-native analytics over collections of published messages."""

__version__ = "0.1.0"
