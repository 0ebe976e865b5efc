from . import numbers, text, times

__all__ = ["numbers", "text", "times"]
