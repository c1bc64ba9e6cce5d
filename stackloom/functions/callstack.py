"""Column expressions over call stacks (arrays) and frames; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackloom.model import MAX_DEPTH


def push(stack: Column, address: Column, max_depth: int = MAX_DEPTH) -> Column:
    """The stack with an address on top; a full stack stays as it is."""
    return F.when(F.size(stack) < max_depth, F.concat(stack, F.array(address))).otherwise(stack)


def pop(stack: Column) -> Column:
    return F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))


def truncate_stack(stack: Column, max_depth: int = MAX_DEPTH) -> Column:
    """The first frames that fit."""
    return F.slice(stack, 1, max_depth)


def frame(stack: Column, index: Column | int) -> Column:
    """Frame at a zero-based index, null outside the stack."""
    i = F.lit(index) if isinstance(index, int) else index
    return F.when(i >= 0, F.try_element_at(stack, i + 1))


def depth(stack: Column) -> Column:
    return F.size(stack)


def is_empty(stack: Column) -> Column:
    return F.size(stack) == 0


def is_full(stack: Column, max_depth: int = MAX_DEPTH) -> Column:
    return F.size(stack) >= max_depth


def stack_hash(stack: Column) -> Column:
    """A bucketing hash; equality of stacks is equality of the arrays, never of hashes."""
    return F.xxhash64(stack)


def root_first(stack: Column, frame_order: str) -> Column:
    """Frames from the root down, given their order in the source."""
    if frame_order not in ("root_first", "leaf_first"):
        raise ValueError(f"frame_order must be root_first or leaf_first, not {frame_order!r}")
    return F.reverse(stack) if frame_order == "leaf_first" else stack


#: The sign bit: flipping it makes signed comparison of longs the unsigned one of their bits.
SIGN = -(1 << 63)


def unsigned(address: Column) -> Column:
    """A key that orders addresses as unsigned numbers."""
    return address.bitwiseXOR(F.lit(SIGN))


def distance(high: Column, low: Column) -> Column:
    """high - low as unsigned addresses, high being the larger; never overflows."""
    return F.when((high < 0) == (low < 0), high - F.when((high < 0) == (low < 0), low).otherwise(F.lit(0))).otherwise(unsigned(unsigned(high) - F.greatest(low, F.lit(0))))


def percentage(part: Column, total: Column) -> Column:
    """part in per cent of total; 0 for an empty total."""
    return F.when(total > 0, part * F.lit(100.0) / total).otherwise(F.lit(0.0))


def source_location(filename: Column, line: Column) -> Column:
    """file:line where both are known, else ''."""
    return F.when((F.coalesce(filename, F.lit("")) != "") & (line > 0), F.concat(filename, F.lit(":"), line.cast("string"))).otherwise("")


def function_key(function: Column, filename: Column, line: Column) -> Column:
    """fn (file:line), or fn alone."""
    where = source_location(filename, line)
    return F.when(where != "", F.concat(function, F.lit(" ("), where, F.lit(")"))).otherwise(function)


def truncated(name: Column, width: int, ellipsis: str = "") -> Column:
    """name cut to width characters, and the ellipsis where something was cut."""
    return F.when(F.length(name) > width, F.concat(F.substring(name, 1, width), F.lit(ellipsis))).otherwise(name)


def hex_address(address: Column, width: int = 0) -> Column:
    digits = F.lower(F.hex(address))
    return F.concat(F.lit("0x"), F.lpad(digits, width, "0") if width else digits)


def wildcard(text: Column, pattern: str, strict: bool = True) -> Column:
    """Whether a text matches a pattern with * for any characters.

    strict=False keeps the older rule: the text starts with what stands before the first * and ends with what stands
    after the last; what is between two stars is not looked at.
    """
    if "*" not in pattern:
        return text == pattern
    parts = pattern.split("*")
    edges = text.startswith(parts[0]) & text.endswith(parts[-1])
    if not strict:
        return edges
    quoted = ".*".join("\\Q" + p.replace("\\E", "\\E\\\\E\\Q") + "\\E" if p else "" for p in parts)
    return text.rlike(f"(?s)\\A{quoted}\\z")
