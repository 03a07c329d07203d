"""evspark subpackage."""
