"""Binary search in a sorted array column, as one SQL expression."""

from __future__ import annotations


def cuts_below(cuts: str, value: str, most: int, strict: bool = True) -> str:
    """SQL for the number of elements of the ascending array ``cuts`` below ``value`` (up to and with
    it, unless ``strict``); 0 for a null array.  ``most`` bounds the array's size (a power of two
    above it); the search takes log2(most) steps."""
    steps = ", ".join(str(most >> i) for i in range(1, most.bit_length()))
    cmp = "<" if strict else "<="
    return (f"if({cuts} is null, 0, aggregate(array({steps}), 0, "
            f"(p, d) -> if(get({cuts}, p + d - 1) {cmp} {value}, p + d, p)))")
