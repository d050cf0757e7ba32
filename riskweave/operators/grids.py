"""Grid-puzzle datasets: augmentation, sequences, ids, batches and vote counting.

A puzzle is a row (puzzle_id, examples array of (input, output, kind)); a puzzle file is one row, so nothing is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.fixed.span_patterns import IGNORE_ID
from riskweave.functions import grids as G
from riskweave.functions.hashing import shuffled, uniform, uniform_int
from riskweave.operators.positions import grouped_running, ordered_index

RETRY_FACTOR = 5


def augment_grids(puzzles: DataFrame, n: int, seed: int = 42, retries: int = RETRY_FACTOR) -> DataFrame:
    """Each puzzle and up to n distinct images of it under a symmetry and a colour permutation (0 stays).

    n x retries candidates per puzzle are tried in order; the first n with a new hash stay, named id_t<k>_<colours>.
    """
    nine = F.array(*[F.lit(i) for i in range(1, G.COLOURS)])

    def draw(trial: Column) -> Column:
        keys, plain = (seed, F.col("puzzle_id"), trial), trial == 0
        return F.struct(
            trial.alias("trial"), F.when(plain, 0).otherwise(uniform_int(0, 7, *keys, "t")).alias("tid"),
            F.when(plain, F.sequence(F.lit(0), F.lit(9))).otherwise(F.concat(F.array(F.lit(0)), shuffled(nine, *keys, "c"))).alias("colours"),
        )

    drawn = puzzles.withColumn("_drawn", F.transform(F.sequence(F.lit(0), F.lit(n * retries)), draw))
    image = lambda part: G.dihedral_sql(f"one.{part}", "d.tid")
    recoloured = f"transform(examples, e -> named_struct('kind', e.kind, 'input', {G.recolour_sql('e.input', 'd.colours')}, 'output', {G.recolour_sql('e.output', 'd.colours')}))"
    turned = f"transform({recoloured}, one -> named_struct('kind', one.kind, 'input', {image('input')}, 'output', {image('output')}))"
    images = drawn.withColumn("_images", F.expr(f"transform(_drawn, d -> named_struct('trial', d.trial, 'tid', d.tid, 'colours', d.colours, 'examples', {turned}))"))
    hashed = images.withColumn("_hashes", F.expr(f"transform(_images, m -> {G.puzzle_hash_sql('m.examples')})"))
    # n x retries + 1 candidates in one row: the first with a hash is where the hash is found first; nothing is shuffled
    new = F.expr("filter(transform(_images, (m, i) -> named_struct('m', m, 'hash', _hashes[i], 'i', i)), x -> array_position(_hashes, x.hash) = x.i + 1)")
    ranked = hashed.select("puzzle_id", F.explode(F.slice(new, 1, n + 1)).alias("_x")).select("puzzle_id", "_x.m.*", "_x.hash")
    name = F.concat(F.col("puzzle_id"), F.lit("_t"), F.col("tid"), F.lit("_"), F.array_join(F.col("colours").cast("array<string>"), ""))
    return ranked.select(
        F.col("puzzle_id").alias("group_id"),
        F.when(F.col("trial") == 0, F.col("puzzle_id")).otherwise(name).alias("puzzle_id"),
        "tid", "colours", "examples", "hash",
    )


def grid_to_sequence(examples: DataFrame, translate: bool = True, seed: int = 42, key: str = "example_id") -> DataFrame:
    """inputs and labels as 900-long sequences at one random offset; rows flagged ``plain`` stay at the corner."""
    room = lambda axis: F.lit(G.SIDE) - F.greatest(axis("input"), axis("output"))
    rows, columns = (lambda g: F.size(g)), (lambda g: F.size(F.get(g, F.lit(0))))
    moved = F.lit(translate) & ~(F.col("plain") if "plain" in examples.columns else F.lit(False))
    shift = lambda axis, tag: F.when(moved, F.floor(uniform(seed, tag, F.col(key)) * (room(axis) + 1)).cast("int")).otherwise(0)
    placed = examples.withColumns({"pad_row": shift(rows, "row"), "pad_column": shift(columns, "column")})
    return placed.withColumns(
        {"inputs": G.to_sequence("input", "pad_row", "pad_column"), "labels": G.to_sequence("output", "pad_row", "pad_column")}
    )


def assign_puzzle_ids(df: DataFrame, name: str, order: str) -> DataFrame:
    """Dense ids from 1 by first appearance (0 is blank), joined back to every row."""
    first = df.groupBy(name).agg(F.min(order).alias("_first"))
    numbered = ordered_index(first, [F.col("_first"), F.col(name)], "_i").select(name, (F.col("_i") + 1).alias("identifier"))
    return df.join(numbered, name)


def dataset_offsets(puzzles: DataFrame, sets: Sequence[str], order: str, count: str) -> DataFrame:
    """Running end offset of every puzzle in its set: the index array of a flat example table."""
    return grouped_running(puzzles, list(sets), [F.col(order)], sums={"puzzle_end": count}, rank="puzzle_no")


def dataset_metadata(puzzles: DataFrame, groups: str = "group_id", count: str = "n_examples") -> DataFrame:
    return puzzles.agg(
        F.count_distinct(groups).alias("total_groups"),
        F.count(F.lit(1)).alias("total_puzzles"),
        F.sum(count).alias("total_examples"),
        (F.sum(count) / F.count(F.lit(1))).alias("mean_puzzle_examples"),
        F.lit(G.COLOURS + G.FIRST_COLOUR).alias("vocab_size"),
        F.lit(G.SIDE * G.SIDE).alias("seq_len"),
    )


def shuffle_board(boards: DataFrame, n: int, seed: int = 42, key: str = "board_id") -> DataFrame:
    """Each 9 x 9 board (81 cells in ``q`` and ``a``) and n valid shufflings: digits renamed, transposed or not, bands
    and rows, stacks and columns permuted alike in question and answer; ids + 1."""
    rows = boards.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(n))))
    keys = (seed, F.col(key), F.col("variant"))
    three = lambda *more: shuffled(F.array(F.lit(0), F.lit(1), F.lit(2)), *keys, *more)
    lines = lambda tag: F.flatten(F.transform(three(tag), lambda b: F.transform(three(tag, b), lambda r: b * 3 + r)))
    same = F.sequence(F.lit(0), F.lit(8))
    plain = F.col("variant") == 0
    drawn = rows.withColumns(
        {
            "digits": F.when(plain, F.sequence(F.lit(0), F.lit(9))).otherwise(
                F.concat(F.array(F.lit(0)), shuffled(F.sequence(F.lit(1), F.lit(9)), *keys, "digits"))
            ),
            "flip": ~plain & (uniform(*keys, "flip") < 0.5),
            "row_order": F.when(plain, same).otherwise(lines("rows")),
            "column_order": F.when(plain, same).otherwise(lines("columns")),
        }
    )
    old = "if(flip, column_order[p % 9] * 9 + row_order[cast(p div 9 as int)], row_order[cast(p div 9 as int)] * 9 + column_order[p % 9])"
    image = lambda cells: F.expr(f"transform(sequence(0, 80), p -> digits[{cells}[{old}]] + 1)")
    return drawn.withColumns({"inputs": image("q"), "labels": image("a")}).drop("digits", "flip", "row_order", "column_order")


def augment_maze(mazes: DataFrame, augment: bool = True) -> DataFrame:
    """All eight symmetries of a square character maze, characters as ids from 1."""
    ids = F.create_map(*[F.lit(x) for i, c in enumerate(G.MAZE_CHARACTERS) for x in (c, i + 1)])
    side = F.sqrt(F.length("q")).cast("int")

    def grid(text: str) -> Column:
        return F.transform(
            F.sequence(F.lit(0), side - 1),
            lambda r: F.transform(F.sequence(F.lit(0), side - 1), lambda c: F.element_at(ids, F.substring(F.col(text), r * side + c + 1, F.lit(1)))),
        )

    rows = mazes.withColumns({"_q": grid("q"), "_a": grid("a")}).withColumn("tid", F.explode(F.sequence(F.lit(0), F.lit(7 if augment else 0))))
    return rows.withColumns({"inputs": F.flatten(G.dihedral("_q", "tid")), "labels": F.flatten(G.dihedral("_a", "tid"))}).drop("_q", "_a")


# -- batches ----------------------------------------------------------------------------------------------------

def pad_batches(rows: DataFrame, batch: str, batch_size: int, seq_len: int, ignore_label: int = 0) -> DataFrame:
    """Ignored labels become -100; short batches get pad rows (inputs 0, labels -100, identifier 0)."""
    masked = rows.withColumn("labels", F.transform("labels", lambda v: F.when(v == ignore_label, IGNORE_ID).otherwise(v)))
    short = rows.groupBy(batch).agg((F.lit(batch_size) - F.count(F.lit(1))).cast("int").alias("missing")).filter("missing > 0")
    filler = lambda v: F.array_repeat(F.lit(v), F.lit(seq_len))
    pads = short.select(batch, F.explode(F.sequence(F.lit(1), F.col("missing"))).alias("_i")).select(
        batch, filler(G.PAD).alias("inputs"), filler(IGNORE_ID).alias("labels"), F.lit(0).cast("bigint").alias("identifier")
    )
    return masked.select(batch, "inputs", "labels", "identifier").unionByName(pads)


# -- answers ----------------------------------------------------------------------------------------------------


def inverse_augment(df: DataFrame, name: str, grid: str, out: str) -> DataFrame:
    """Undoes symmetry and colours read from the name id_t<k>_<colours>; other names leave the grid."""
    parts = F.split(name, "_")
    parsed = df.withColumns(
        {
            "_tid": F.coalesce(F.try_element_at(parts, F.lit(-2)).substr(F.lit(2), F.lit(1)).try_cast("int"), F.lit(0)),
            "_map": F.transform(F.filter(F.split(F.element_at(parts, -1), ""), lambda c: c != ""), lambda c: c.try_cast("int")),
            "_changed": F.col(name).contains("_"),
        }
    )
    turned = parsed.withColumn("_g", G.inverse_dihedral(grid, "_tid"))
    restored = F.when(F.col("_changed"), F.expr(G.unrecolour_sql("_g", "_map"))).otherwise(F.col(grid))
    return turned.withColumn(out, restored).drop("_tid", "_map", "_changed", "_g")


def vote_predictions(votes: DataFrame, answers: DataFrame, ks: Sequence[int] = (1, 2, 10, 100, 1000)) -> DataFrame:
    """Share of puzzles solved within the k most voted answers, in percent, per k.

    ``votes``: puzzle_id, input_hash, pred_hash, q. ``answers``: puzzle_id, input_hash, label_hash. Order is by votes,
    then mean q, then hash; the rank of the right answer is one plus the number of answers before it, so no answer list
    is sorted or gathered. A puzzle counts if all its tests are right.
    """
    test = ["puzzle_id", "input_hash"]
    tallied = votes.groupBy(*test, "pred_hash").agg(F.count(F.lit(1)).alias("n"), F.avg("q").alias("mean_q"))
    right = answers.join(tallied.withColumnRenamed("pred_hash", "label_hash"), [*test, "label_hash"], "left").select(
        *test, "label_hash", F.col("n").alias("right_n"), F.col("mean_q").alias("right_q")
    )
    beside = tallied.join(right, test)
    ahead = (F.col("n") > F.col("right_n")) | (
        (F.col("n") == F.col("right_n"))
        & ((F.col("mean_q") > F.col("right_q")) | ((F.col("mean_q") == F.col("right_q")) & (F.col("pred_hash") < F.col("label_hash"))))
    )
    ranked = beside.groupBy(*test).agg(F.count_if(ahead).alias("before"), F.max("right_n").alias("right_n"))
    per_test = answers.select(*test).join(ranked, test, "left")
    found = F.col("right_n").isNotNull()
    worst = per_test.groupBy("puzzle_id").agg(F.max(F.when(found, F.col("before") + 1)).alias("rank"), F.bool_and(found).alias("all_found"))
    shares = [F.avg((F.col("all_found") & (F.col("rank") <= k)).cast("double")) * 100 for k in ks]
    rows = worst.agg(F.array(*[F.struct(F.lit(k).alias("k"), s.alias("percent")) for k, s in zip(ks, shares)]).alias("r"))
    return rows.select(F.inline("r"))
