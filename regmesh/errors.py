"""Errors that users of the engine may meet."""


class RegmeshError(ValueError):
    """Base of all errors of the engine."""


class FormulaSyntaxError(RegmeshError):
    """A formula that cannot be read."""


class UnderDeterminedIVError(RegmeshError):
    """Fewer instruments than endogenous variables."""


class EndogVarsAsCovarsError(RegmeshError):
    """An endogenous variable that is also a covariate."""


class InstrumentsAsCovarsError(RegmeshError):
    """An instrument that is also a covariate."""


class VcovTypeNotSupportedError(RegmeshError):
    """A covariance that the model does not offer."""


class NanInClusterVarError(RegmeshError):
    """Null values in a cluster variable."""


class DepvarIsNotNumericError(RegmeshError):
    """A dependent variable that is not numeric."""


class DepvarOutsideDomainError(RegmeshError):
    """A dependent variable outside the family's domain."""


class NonPositiveWeightsError(RegmeshError):
    """Weights that are not numeric and strictly positive."""


class NonConvergenceError(RegmeshError):
    """An iteration that did not converge."""


class EmptySampleError(RegmeshError):
    """No rows are left after the sample rules."""
