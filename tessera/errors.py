"""What can go wrong, by kind."""


class ArrayError(Exception):
    """Any error of this package."""


class BadRequest(ArrayError):
    """The caller asked for something that is not there or has the wrong shape."""


class Malformed(ArrayError):
    """Bytes that contradict their format."""


class Unsupported(ArrayError):
    """A feature of a format that is not read; never answered with wrong data."""


class NotFound(BadRequest):
    """A variable, group, dimension or attribute of that name is not there."""


class OutOfBounds(BadRequest):
    """A selection reaches past the end of an axis."""


class TypeMismatch(BadRequest):
    """Values of one kind were asked for as another they cannot become."""


class ChecksumMismatch(Malformed):
    """Stored and computed sums differ."""
