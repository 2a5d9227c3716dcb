"""The same operators over tables that are still growing."""
