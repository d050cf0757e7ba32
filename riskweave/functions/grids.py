"""Grids as array<array<int>>: symmetries, colours, sequences and crops, composed as SQL over a named column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the grid encoding.
SIDE = 30
PAD, EOS, FIRST_COLOUR = 0, 1, 2
COLOURS = 10
INVERSE = [0, 3, 2, 1, 4, 5, 6, 7]
MAZE_CHARACTERS = "# SGo"

# Cell (i, j) of the image as a cell of g with last row r and last column c; swapped images have c + 1 rows.
_CELLS = {
    0: ("g[i][j]", False), 1: ("g[j][c - i]", True), 2: ("g[r - i][c - j]", False), 3: ("g[r - j][i]", True),
    4: ("g[i][c - j]", False), 5: ("g[r - i][j]", False), 6: ("g[j][i]", True), 7: ("g[r - j][c - i]", True),
}


def _image(grid: str, transform_id: int) -> str:
    cell, swapped = _CELLS[transform_id]
    cell = cell.replace("g[", f"{grid}[").replace(" r ", " ").replace("[r ", f"[size({grid}) - 1 ").replace("[c ", f"[size({grid}[0]) - 1 ")
    rows, columns = (f"size({grid}[0])", f"size({grid})") if swapped else (f"size({grid})", f"size({grid}[0])")
    return f"transform(sequence(0, {rows} - 1), i -> transform(sequence(0, {columns} - 1), j -> {cell}))"


def dihedral_sql(grid: str, transform_id: str) -> str:
    """One of eight symmetries; ``transform_id`` is a SQL expression."""
    cases = " ".join(f"when {t} then {_image(grid, t)}" for t in range(1, 8))
    return f"case {transform_id} {cases} else {grid} end"


def dihedral(grid: str, transform_id: str | int) -> Column:
    return F.expr(dihedral_sql(grid, str(transform_id)))


def inverse_dihedral(grid: str, transform_id: str | int) -> Column:
    table = ", ".join(str(t) for t in INVERSE)
    return F.expr(dihedral_sql(grid, f"element_at(array({table}), {transform_id} + 1)"))


def recolour_sql(grid: str, mapping: str) -> str:
    """Every colour v becomes mapping[v]."""
    return f"transform({grid}, line -> transform(line, v -> {mapping}[v]))"


def unrecolour_sql(grid: str, mapping: str) -> str:
    """The inverse: every colour v becomes its position in the mapping."""
    return f"transform({grid}, line -> transform(line, v -> cast(array_position({mapping}, v) - 1 as int)))"


def grid_text(grid: str) -> str:
    """SQL of a text that identifies shape and content."""
    return f"array_join(transform({grid}, line -> array_join(line, ',')), ';')"


def grid_hash(grid: str) -> Column:
    return F.expr(f"sha2({grid_text(grid)}, 256)")


def puzzle_hash_sql(examples: str) -> str:
    """Hash of a list of (input, output) that does not depend on their order."""
    one = f"concat(sha2({grid_text('e.input')}, 256), '|', sha2({grid_text('e.output')}, 256))"
    return f"sha2(array_join(array_sort(transform({examples}, e -> {one})), '|'), 256)"


def to_sequence(grid: str, pad_row: str, pad_column: str) -> Column:
    """Grid at an offset in a 30 x 30 field, colours + 2, an end mark below and right of it, flattened."""
    rows, columns = f"size({grid})", f"size({grid}[0])"
    r, c = f"(p div {SIDE} - {pad_row})", f"(p % {SIDE} - {pad_column})"
    value = (
        f"case when {r} >= 0 and {r} < {rows} and {c} >= 0 and {c} < {columns} then {grid}[cast({r} as int)][cast({c} as int)] + {FIRST_COLOUR} "
        f"when ({r} = {rows} and {c} >= 0 and {c} < {columns}) or ({c} = {columns} and {r} >= 0 and {r} < {rows}) then {EOS} else {PAD} end"
    )
    return F.expr(f"transform(sequence(0, {SIDE * SIDE - 1}), p -> {value})")


def crop(sequence: str) -> Column:
    """Largest rectangle from the corner without an end or pad mark, colours - 2; the first of equal areas."""
    lines = f"transform(sequence(0, {SIDE - 1}), q -> slice({sequence}, q * {SIDE} + 1, {SIDE}))"
    clear = (
        f"transform({lines}, line -> coalesce(nullif(array_position(transform(line, v -> v < {FIRST_COLOUR} or v > {FIRST_COLOUR + COLOURS - 1}), true), 0) - 1, {SIDE}))"
    )
    start = f"named_struct('row', 0L, 'width', {SIDE}L, 'area', 0L, 'best_row', 0L, 'best_width', 0L)"
    width = "least(s.width, n)"
    better = f"(s.row + 1) * {width} > s.area"
    step = (
        f"named_struct('row', s.row + 1, 'width', {width}, 'area', if({better}, (s.row + 1) * {width}, s.area), "
        f"'best_row', if({better}, s.row + 1, s.best_row), 'best_width', if({better}, {width}, s.best_width))"
    )
    best = f"aggregate({clear}, {start}, (s, n) -> {step})"
    cut = (
        f"transform(slice({lines}, 1, cast(b.best_row as int)), line -> "
        f"transform(slice(line, 1, cast(b.best_width as int)), v -> v - {FIRST_COLOUR}))"
    )
    return F.expr(f"get(transform(array({best}), b -> {cut}), 0)")
