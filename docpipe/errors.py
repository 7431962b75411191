"""Errors with the numeric codes that document databases use."""


class DocError(Exception):
    code = 2
    code_name = "BadValue"

    def __init__(self, message: str, code: int | None = None, code_name: str | None = None):
        super().__init__(message)
        self.code = code if code is not None else type(self).code
        self.code_name = code_name or type(self).code_name


class TypeMismatch(DocError):
    code, code_name = 14, "TypeMismatch"


class IllegalOperation(DocError):
    code, code_name = 20, "IllegalOperation"


class NamespaceNotFound(DocError):
    code, code_name = 26, "NamespaceNotFound"


class IndexNotFound(DocError):
    code, code_name = 27, "IndexNotFound"


class NamespaceExists(DocError):
    code, code_name = 48, "NamespaceExists"


class CannotCreateIndex(DocError):
    code, code_name = 67, "CannotCreateIndex"


class InvalidOptions(DocError):
    code, code_name = 72, "InvalidOptions"


class InvalidNamespace(DocError):
    code, code_name = 73, "InvalidNamespace"


class WriteConflict(DocError):
    code, code_name = 112, "WriteConflict"


class DuplicateKey(DocError):
    code, code_name = 11000, "DuplicateKey"


class BadHint(DocError):
    code, code_name = 17007, "BadHint"


class BulkWriteError(DocError):
    code, code_name = 65, "BulkWriteError"

    def __init__(self, errors: list[dict], result: dict):
        super().__init__(f"{len(errors)} of the bulk operations failed")
        self.errors, self.result = errors, result


class UnknownOperator(DocError):
    code, code_name = 168, "InvalidPipelineOperator"
