"""What can go wrong, by kind."""


class DocumentError(Exception):
    """The base of all."""


class OpenError(DocumentError):
    """The source can't be opened as a document."""


class PasswordRequired(OpenError):
    """The source is locked and no password was given."""


class WrongPassword(OpenError):
    """The password doesn't open the source."""


class SourceMismatch(DocumentError):
    """The document was read from another source."""


class InvariantError(DocumentError):
    """A document breaks a constraint."""


class StrictModeError(DocumentError):
    """Strict reading, and a finding of severity error."""
