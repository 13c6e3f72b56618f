"""Errors of the engine; all derive from :class:`PactError`, a RuntimeError."""


class PactError(RuntimeError):
    """Any failure that the engine reports itself."""


class ContractError(PactError):
    """A contract can't be read or resolved."""


class ContractNotFound(ContractError):
    def __init__(self, dataset: str):
        super().__init__(f"no contract for dataset '{dataset}'")


class UnknownMaskAction(ContractError):
    def __init__(self, action: str, column: str | None = None):
        super().__init__(f"unknown mask action '{action}'" + (f" for column '{column}'" if column else ""))


class ContractDenied(PactError):
    def __init__(self, dataset: str, reason: str):
        super().__init__(f"contract denied access to '{dataset}': {reason}")
        self.reason = reason


class ResolutionFailed(PactError):
    def __init__(self, dataset: str, cause: object):
        super().__init__(f"contract resolution failed for '{dataset}': {cause}")


class BindingFailed(PactError):
    def __init__(self, dataset: str, cause: object):
        super().__init__(f"binding failed for '{dataset}': {cause}")


class UnsafeStatement(PactError):
    def __init__(self, verb: str):
        super().__init__(f"unsafe DDL rejected: statement contains disallowed verb '{verb}'")
        self.verb = verb


class NotAQuery(PactError):
    """The statement is no plain query, or uses a relation or function that queries may not use."""


class MissingBundle(PactError):
    def __init__(self):
        super().__init__("no contract bundle: inject one before the first query")


class ContractNotApproved(PactError):
    """An operator was given data that no contract approved."""


class MalformedBundle(PactError):
    """A bundle's bytes are no valid policy document."""


class UnsupportedPredicate(PactError):
    """A row filter uses more than the predicate grammar allows."""


class MaskTypeUnsupported(PactError):
    def __init__(self, column: str, action: str, kind: str):
        super().__init__(f"mask '{action}' does not apply to column '{column}' of type {kind}")


class UnknownColumn(PactError):
    """A contract names a column that the data doesn't have."""


class NoiseTypeUnsupported(PactError):
    def __init__(self, column: str, kind: str):
        super().__init__(f"noise does not apply to column '{column}' of type {kind}")


class InvalidNoiseParameters(PactError):
    """Epsilon or sensitivity is not a finite positive number."""


class BudgetExhausted(PactError):
    def __init__(self, tenant: str, column: str, wanted: float, left: float):
        super().__init__(f"privacy budget exhausted for column '{column}' of tenant '{tenant}': {wanted} wanted, {left} left")


class MissingContractReference(PactError):
    """An attestation needs the contract's id and version."""


class ConfigError(PactError):
    """A setting is empty or out of range."""


class ResultTooLarge(PactError):
    def __init__(self, most: int):
        super().__init__(f"the result has more than {most} rows")


class QueueFull(PactError):
    """A worker's queue has no room."""


class PoolShutdown(PactError):
    """The pool takes no more queries."""


class VerifyError(ContractError):
    """A signed bundle's digest or signature is wrong."""


class BlobError(PactError):
    """The byte-range service failed."""


class BlobAccessDenied(BlobError):
    """The byte-range service refused access."""


class BlobRangeError(BlobError):
    """The range lies outside the blob."""


class SigningRefused(PactError):
    """The signing service refused an envelope."""
