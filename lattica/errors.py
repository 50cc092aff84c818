"""What the engine raises; each class names one kind of misuse or failed contract."""

from __future__ import annotations


class LatticaError(Exception):
    """Base of all errors raised here."""


class EmptySequence(LatticaError):
    """An aggregate or positional operator that needs a row found none."""


class MoreThanOne(LatticaError):
    """single() found several rows."""


class OrderRequired(LatticaError):
    """A positional operator was called on a dataset without an order."""


class NotOrdered(LatticaError):
    """check_order_by found neighbours out of order."""


class BadPartitionCount(LatticaError, ValueError):
    """A partition count below one."""


class BadSeparators(LatticaError, ValueError):
    """Range separators that are missing, unsorted or of the wrong number."""


class BadWindow(LatticaError, ValueError):
    """A sliding window of fewer than one row."""


class BadIteration(LatticaError, ValueError):
    """A negative repeat count, or a loop that did not end."""


class StoreExists(LatticaError):
    """A store to be written exists and may not be replaced."""


class DuplicateStore(LatticaError):
    """One submission names the same store twice."""


class UnknownScheme(LatticaError, ValueError):
    """No provider is registered for a URI's scheme."""


class BadStore(LatticaError, ValueError):
    """A store's index can't be read."""


class PartitionMismatch(LatticaError):
    """A pairwise operator got inputs with unequal partition counts."""


class NameClash(LatticaError, ValueError):
    """A column that an operator adds has a name that the dataset uses."""


class Disposed(LatticaError):
    """A context was used after close()."""
