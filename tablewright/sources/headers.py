"""Header cells to column names."""

from __future__ import annotations

from collections.abc import Sequence


def normalised_names(cells: Sequence[object]) -> list[str]:
    """Missing cells become ``col_<i>``; the second and later uses of a name get ``_1``, ``_2``.

    A number is passed over where the name with it is taken.
    """
    uses: dict[str, int] = {}
    names: list[str] = []
    for i, cell in enumerate(cells):
        own = name = f"col_{i}" if cell is None else str(cell)
        count = uses.get(own, 0)
        while name in names or (count and name == own):
            count = count or 1
            name = f"{own}_{count}"
            count += name in names
        uses[own] = max(count, uses.get(own, 0)) + 1
        names.append(name)
    return names
