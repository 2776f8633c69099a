"""Variable-length lists to fixed shapes.

Caps are small constants (3 to 6 objects). A single list is written out slot by slot with ``get``, in
generated code. Whole collections are not: a few hundred slots make a method that the JVM leaves
uncompiled, or that does not compile at all, so a collection is one ``transform`` over features and slots. All is
generated as SQL text: one parsed expression per tensor instead of a driver round trip per node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from setframe.config import PAD_VALUE
from setframe.functions.clean import MAX_DOUBLE


def _finite(x: str) -> str:
    """NaN to 0 and infinities to the largest finite values, for an ``x`` that is never NULL.

    A clamp mentions its operand once, so the slot is looked up once.
    """
    return f"greatest({-MAX_DOUBLE!r}D, least({MAX_DOUBLE!r}D, nanvl({x}, 0D)))"


def _filled(x: str, fill: float) -> str:
    return f"coalesce(cast({x} as double), {float(fill)!r}D)"


def slot_sql(objects: str, feature: str, slot: int, fill: float = PAD_VALUE,
             clean: bool = True) -> str:
    """One field of one object of an ``array<struct>`` column, padded and made finite."""
    filled = _filled(f"get(`{objects}`, {slot}).`{feature}`", fill)
    return _finite(filled) if clean else filled


def pad_clip(lists: str, cap: int, fill: float = PAD_VALUE, clean: bool = False) -> Column:
    """First ``cap`` elements of an array column; absent or NULL elements become ``fill``."""
    filled = [_filled(f"get(`{lists}`, {i})", fill) for i in range(cap)]
    return F.expr(_array([_finite(x) if clean else x for x in filled]))


def object_tensor(objects: str, features: Sequence[str], cap: int, fill: float = PAD_VALUE,
                  clean: bool = True) -> Column:
    """``array<array<double>>`` of shape (feature, object) from an ``array<struct>`` column."""
    return F.expr(_array([_array([slot_sql(objects, f, i, fill, clean) for i in range(cap)])
                          for f in features]))


def flat_tensor(objects: str, features: Sequence[str], cap: int, fill: float = PAD_VALUE,
                clean: bool = True) -> Column:
    """The same values as :func:`object_tensor`, feature-major in one ``array<double>``.

    One flat list per row is what Arrow hands to numpy without copying element by element.
    """
    return F.expr(_by_feature([f"`{objects}`.`{f}`" for f in features], cap, fill, clean))


def list_tensor(lists: Sequence[str], cap: int, fill: float = PAD_VALUE) -> Column:
    """Flat (feature, object) tensor when every feature is an ``array<double>`` column itself."""
    return F.expr(_by_feature([f"`{a}`" for a in lists], cap, fill, True))


def _by_feature(lists: Sequence[str], cap: int, fill: float, clean: bool) -> str:
    """One step over the features and slots, so that code does not grow with their number."""
    slots = f"array({', '.join(map(str, range(cap)))})"
    value = _filled("get(_list, _i)", fill)
    value = _finite(value) if clean else value
    features = _array([f"cast({x} as array<double>)" for x in lists])
    return f"flatten(transform({features}, _list -> transform({slots}, _i -> {value})))"


def scalar_vector(columns: Sequence[str]) -> Column:
    """Scalars as one finite vector; NULL counts as NaN does."""
    return F.expr(_array([_finite(f"coalesce(cast(`{c}` as double), 0D)") for c in columns]))


def masked_sum(objects: str, features: Sequence[str], cap: int,
               fill: float = PAD_VALUE) -> list[Column]:
    """Per-feature sum over the object slots that are not all pad."""
    pooled = []
    for f in features:
        terms = []
        for i in range(cap):
            padded = " and ".join(f"{slot_sql(objects, g, i, fill)} = {float(fill)!r}D"
                                  for g in features)
            terms.append(f"if({padded}, 0D, {slot_sql(objects, f, i, fill)})")
        pooled.append(F.expr(" + ".join(terms)))
    return pooled


def multiplicity(lists: str) -> Column:
    return F.coalesce(F.size(lists), F.lit(0))


def _array(items: Sequence[str]) -> str:
    return f"array({', '.join(items)})"

