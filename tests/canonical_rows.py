"""Canonical JSON text of a value, as JavaScript's JSON.stringify with sorted keys writes it (for tests)."""

import decimal
import json


def _utf16_key(k):
    return k.encode("utf-16-be", "surrogatepass")


def js_number(x) -> str:
    """``String(x)`` of a JavaScript number."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int):
        x = float(x) if abs(x) >= 2 ** 53 else x
        if isinstance(x, int):
            return str(x)
    if x != x or x in (float("inf"), float("-inf")):
        return "null"                      # JSON.stringify(NaN / Infinity)
    if x == 0:
        return "0"
    r = repr(float(x))
    ax = abs(x)
    if 1e-6 <= ax < 1e21:
        d = decimal.Decimal(r)
        s = format(d, "f")
        if "." in s:
            s = s.rstrip("0").rstrip(".")
        return s
    mant, _, exp = r.partition("e")
    if "." in mant:
        mant = mant.rstrip("0").rstrip(".")
    e = int(exp)
    return f"{mant}e{'+' if e > 0 else '-'}{abs(e)}"


def canonical_value(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, dict):
        keys = sorted(v.keys(), key=_utf16_key)
        return "{" + ",".join(f'"{k}":{canonical_value(v[k])}' for k in keys) + "}"
    if isinstance(v, list):
        return "[" + ",".join(canonical_value(x) for x in v) + "]"
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    if isinstance(v, (bool, int, float)):
        return js_number(v)
    raise TypeError(type(v))


def canonical_json_text(text: str | None) -> str | None:
    """Canonical text; NULL for a missing text and for one that isn't JSON."""
    try:
        return None if text is None else canonical_value(json.loads(text))
    except (ValueError, RecursionError):
        return None
