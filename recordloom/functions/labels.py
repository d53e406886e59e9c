"""Labels for subtypes and for check results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.schemas import SUBTYPE_LABELS

# fixed values: labels outside the six civil subtypes, per labelling rule
_OTHER = {
    "A": {"X": None, "missing": "NO INFORMATION", "else": None},
    "B": {"X": "OTHER CIVIL", "missing": "NO INFORMATION", "else": "NO INFORMATION"},
    "V2": {"X": "OTHER CIVIL", "missing": "NO INFORMATION", "else": "UNKNOWN"},
}


def label_subtype(subtype: Column, mode: str = "A") -> Column:
    """Readable category of a subtype code.

    ``A``: the civil subtypes; ``B``: the remaining ones; ``V2``: all subtypes, unknown codes told apart.
    """
    other = _OTHER[mode]
    known = F.create_map(*[F.lit(x) for pair in SUBTYPE_LABELS.items() for x in pair])
    return (
        F.when(subtype.isNull(), F.lit(other["missing"]))
        .when(subtype.isin(*SUBTYPE_LABELS), F.try_element_at(known, subtype))
        .when(subtype == "X", F.lit(other["X"]))
        .otherwise(F.lit(other["else"]))
    )


def threshold_status(value: Column, ok_above: int) -> Column:
    """OK above the expected size, WARN below it, FAIL for nothing."""
    return F.when(value > ok_above, "OK").when(value > 0, "WARN").otherwise("FAIL")
