"""Errors that users may meet."""

__all__ = ["ClassNotFoundError", "CoordinateNotFoundError", "DuplicateCoordinateError", "EngineError", "EvaluationError", "FileFormatError", "InconsistentDimensionsError", "InvalidCommandLineOptionError", "InvalidDataTypeError", "InvalidVariableError", "NoDataInSubsetError", "ProductPluginError"]


class EngineError(Exception):
    """Base of all."""


class InvalidVariableError(EngineError):
    pass


class CoordinateNotFoundError(EngineError):
    pass


class DuplicateCoordinateError(EngineError):
    pass


class ClassNotFoundError(EngineError):
    pass


class InvalidCommandLineOptionError(EngineError):
    pass


class NoDataInSubsetError(EngineError):
    pass


class InconsistentDimensionsError(EngineError):
    pass


class InvalidDataTypeError(EngineError):
    pass


class ProductPluginError(EngineError):
    pass


class EvaluationError(EngineError):
    pass


class FileFormatError(EngineError):
    def __init__(self, errors):
        self.errors = [errors] if isinstance(errors, str) else list(errors)
        super().__init__("; ".join(self.errors))
