"""All operators under their names, in one place."""

from gridweave.functions.expressions import evaluate
from gridweave.grid import Grid, densify, full
from gridweave.operators import aliases, binary, coords, filters, frequency, graph, labels, morphology, pointwise, reduce, transforms
from gridweave.operators.pointwise import create
from gridweave.operators.transforms import AffineTransform

_OWN = "gridweave.operators"
OPERATORS = {
    name: f
    for module in (pointwise, binary, coords, reduce, filters, morphology, labels, graph, transforms, frequency)
    for name, f in vars(module).items()
    if callable(f) and not name.startswith("_") and str(getattr(f, "__module__", "")) == module.__name__ and not isinstance(f, type)
}
OPERATORS |= aliases.ALIASES | {"evaluate": evaluate}
globals().update(OPERATORS)

__all__ = ["OPERATORS", "AffineTransform", "Grid", "create", "densify", "full", *OPERATORS]
