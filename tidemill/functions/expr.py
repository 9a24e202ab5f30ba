"""Column expressions the engine's queries share; all run in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def alpha(half_life: float) -> float:
    """Weight of the newest row of an exponential average with this half life in rows."""
    if not half_life > 0:
        raise ValueError("a half life must be positive")
    return 1.0 - 2.0 ** (-1.0 / half_life)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), x))))


def total(a: Column) -> Column:
    """Sum of an array of doubles; 0 for an empty one, null if any element is null."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def argmax(a: Column) -> Column:
    """Position from 0 of the largest element, the first of equals; null for an empty array."""
    return F.when(F.size(a) > 0, (F.array_position(a, F.array_max(a)) - 1).cast("int"))


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / total(e))


def entropy(p: Column) -> Column:
    """Shannon entropy in nats; zero probabilities add nothing."""
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))


def herfindahl(w: Column) -> Column:
    """Concentration of absolute weights; 1 where there is no weight."""
    gross = total(F.transform(w, lambda x: F.abs(x)))
    return F.when(gross > 1e-12, total(F.transform(w, lambda x: F.pow(x / gross, F.lit(2.0))))).otherwise(1.0)


def half_life(beta: Column) -> Column:
    """Rows in which a deviation halves under x(n) = beta x(n-1); null outside (1e-6, 0.999)."""
    return F.when((beta > 1e-6) & (beta < 0.999), -math.log(2.0) / F.ln(beta))


def within(observed: Column, wanted: Column, rel: float = 1e-9, absolute: float = 1e-12) -> Column:
    """Equality up to a relative or an absolute tolerance."""
    return F.abs(observed - wanted) <= F.greatest(rel * F.greatest(F.abs(observed), F.abs(wanted)), F.lit(absolute))


def is_sha256(s: Column) -> Column:
    return s.rlike("^[0-9a-f]{64}$")


def logical_path(s: Column) -> Column:
    """Forward slashes, none repeated, no leading ./; null for absolute paths and those that climb."""
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\\", "/"), "/+", "/"), r"^(\./)+", "")
    return F.when(~p.rlike(r"^(/|[A-Za-z]:)|(^|/)\.\.(/|$)"), p)


def is_uuid(s: Column) -> Column:
    return s.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def is_commit(s: Column) -> Column:
    """A full commit id: 40 hexadecimal digits, or 64."""
    return s.rlike("^([0-9a-f]{40}|[0-9a-f]{64})$")


def six_places(x: Column) -> Column:
    """A number with exactly six digits after the point."""
    return F.format_string("%.6f", x)


def uuid5(namespace: str, name: Column) -> Column:
    """The UUID (version 5) of a name in a namespace, itself a UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    # the four variant bits keep their lower two
    variant = F.lower(F.hex((F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3)) + 8))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def json_at(doc: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text; numbers pick elements of arrays;
    null where there is none."""
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))
    return F.get_json_object(doc, "$" + steps)
