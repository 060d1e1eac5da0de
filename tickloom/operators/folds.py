"""Ordered folds with resets, for rules no window frame can express.

A ``Fold`` walks the rows of one key in order, carries a small tuple of doubles and
emits rows.  ``fold_rows`` runs it inside ``mapInPandas`` over sorted partitions, so a
task holds one Arrow batch and one state at a time.

A key too large for one task is cut into runs that are folded in parallel from a
guessed entry state.  Because a reset forgets the past, most runs leave with the same
exit state whatever they entered with.  Runs whose entry differs from the exit of the
run before them are folded again from that exit until nothing changes; the first wrong
run of each key becomes right in every pass, so the result always equals the serial
fold.

A fold that can say what a run does to every state it may be entered with (``transfer``) is done after two passes,
however long the key: the first makes one function a run, these are applied one after the other to small rows, and the
second folds the runs whose true entry is not the guessed one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.ordered import PART, SLOT, is_cut, small_side, split
from tickloom.session import reliable

State = tuple[float, ...]
Arrays = dict[str, np.ndarray]

ENTRY = "_entry"
EXIT = "_exit"
MAP = "_map"
SAME = "_same"


@dataclass(frozen=True)
class Fold:
    """``step(state, rows) -> (emitted columns, state)`` over consecutive rows of a key."""

    inputs: Sequence[str]
    initial: State
    emits: T.StructType
    step: Callable[[State, Arrays], tuple[Arrays, State]]
    # The run as a function of its entry, as numbers, or None where that is not possible; and how to apply it. Optional.
    transfer: Callable[[Arrays], Sequence[float] | None] | None = field(default=None)
    through: Callable[[Sequence[float], State], State] | None = field(default=None)


def _walk(fold: Fold, keys: list[str], with_exit: bool, with_map: bool = False):
    """``with_map``: the exit row of a run also has its ``transfer``, for which the rows of the run are held together."""
    names = [f.name for f in fold.emits]
    columns = [*keys, *names, *([EXIT, MAP] if with_exit else [])]

    def add(found: dict[str, list], key: tuple, size: int, columns: Arrays | None, state: State | None, run: list[Arrays] | None = None) -> None:
        for k, v in zip(keys, key):
            found[k].extend([v] * size)
        for name in names:
            found[name].extend([None] if columns is None else columns[name])
        if with_exit:
            found[EXIT].extend([None if state is None else list(state)] * size)
            made = fold.transfer({c: np.concatenate([r[c] for r in run]) for c in fold.inputs}) if run else None
            found[MAP].extend([None if made is None else list(made)] * size)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        state, run = fold.initial, []
        for pdf in batches:
            if pdf.empty:
                continue
            change = np.zeros(len(pdf), dtype=bool)
            change[0] = True
            for k in keys:
                values = pdf[k].to_numpy()
                change[1:] |= values[1:] != values[:-1]
            starts = np.flatnonzero(change)
            arrays = {c: pdf[c].to_numpy() for c in fold.inputs}
            found: dict[str, list] = {c: [] for c in columns}
            for start, stop in zip(starts, [*starts[1:], len(pdf)]):
                here = tuple(pdf[k].iat[start] for k in keys)
                if here != key:
                    if with_exit and key is not None:
                        add(found, key, 1, None, state, run)
                    key = here
                    state, run = fold.initial, []
                    if ENTRY in pdf.columns and pdf[ENTRY].iat[start] is not None:
                        state = tuple(float(v) for v in pdf[ENTRY].iat[start])
                part = {c: a[start:stop] for c, a in arrays.items()}
                if with_map and fold.transfer:
                    run.append(part)
                emitted, state = fold.step(state, part)
                add(found, key, len(emitted[names[0]]), emitted, None)
            if found[columns[0]]:
                yield pd.DataFrame(found)
        if with_exit and key is not None:
            found = {c: [] for c in columns}
            add(found, key, 1, None, state, run)
            yield pd.DataFrame(found)

    return walk


def _output_schema(df: DataFrame, keys: Sequence[str], fold: Fold, with_exit: bool) -> T.StructType:
    fields = [df.schema[k] for k in keys] + [T.StructField(f.name, f.dataType, True) for f in fold.emits]
    if with_exit:
        fields += [T.StructField(name, T.ArrayType(T.DoubleType()), True) for name in (EXIT, MAP)]
    return T.StructType(fields)


def fold_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold, placed: bool = False
) -> DataFrame:
    """Emitted rows of ``fold`` for every key, with the key columns in front.

    ``placed`` says that ``split`` has been applied and that rows it left uncut already sit
    in hash partitions of ``keys``; it saves the measurement and the shuffle.
    """
    keys = list(keys)
    extra = [PART, SLOT] if is_cut(df) else []
    needed = df.select(*dict.fromkeys([*keys, *order, *fold.inputs, *extra]))
    cut = split(needed, keys, order, checked=placed)
    if is_cut(cut):
        return _fold_runs(cut, keys, fold)
    here = needed if placed else needed.repartition(*keys)
    # The order columns have done their work once the rows are sorted.
    placed = here.sortWithinPartitions(*keys, *order).select(*dict.fromkeys([*keys, *fold.inputs]))
    return placed.mapInPandas(_walk(fold, keys, False), _output_schema(df, keys, fold, False))


def _fold_runs(cut: DataFrame, keys: list[str], fold: Fold) -> DataFrame:
    part_keys = [*keys, PART]
    ready = cut.repartition(*part_keys).sortWithinPartitions(*part_keys, SLOT)
    schema = _output_schema(cut, part_keys, fold, True)
    walk = _walk(fold, part_keys, True)
    inputs = [c for c in fold.inputs if c not in part_keys]
    is_exit = F.col(EXIT).isNotNull()

    first = reliable(ready.select(*part_keys, *inputs).mapInPandas(_walk(fold, part_keys, True, True), schema))
    emitted = first.filter(~is_exit).drop(EXIT, MAP)
    states = first.filter(is_exit).select(*part_keys, EXIT, MAP).withColumn(ENTRY, F.array(*map(F.lit, fold.initial)))

    while True:
        chained = reliable(_chain(states, keys, fold))
        stale = chained.filter(~F.col(SAME))
        if stale.isEmpty():
            return emitted.drop(PART)
        entries = stale.select(*part_keys, ENTRY)
        again = cut.join(small_side(entries), part_keys).repartition(*part_keys).sortWithinPartitions(*part_keys, SLOT)
        redone = reliable(again.select(*part_keys, ENTRY, *inputs).mapInPandas(walk, schema))
        fixed = redone.filter(is_exit).select(*part_keys, EXIT).join(stale.drop(EXIT, SAME), part_keys)
        states = chained.filter(SAME).drop(SAME).unionByName(fixed)
        kept = emitted.join(stale.select(*part_keys), part_keys, "left_anti")
        emitted = reliable(kept.unionByName(redone.filter(~is_exit).drop(EXIT, MAP)))


def _chain(states: DataFrame, keys: list[str], fold: Fold) -> DataFrame:
    """Entry each run should have, given the exits known so far; one row per run.

    SAME is false for a run that was folded from another entry. Its exit follows from its function where
    there is one; else its last exit serves as the guess for the run after it.
    """

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, fold.initial
        for pdf in batches:
            entries, same = [], []
            for *here, entry, exit_, pieces in zip(*(pdf[c] for c in [*keys, ENTRY, EXIT, MAP])):
                if here != key:
                    key, state = here, fold.initial
                entries.append(list(state))
                same.append(tuple(entry) == state)
                state = tuple(exit_) if same[-1] or pieces is None else tuple(fold.through(pieces.tolist(), state))
            yield pdf[[*keys, PART, EXIT, MAP]].assign(**{ENTRY: entries, SAME: same})

    states = states.select(*keys, PART, EXIT, MAP, ENTRY)
    placed = states.repartition(*keys).sortWithinPartitions(*keys, PART)
    fields = [T.StructField(f.name, f.dataType) for f in states.schema]
    return placed.mapInPandas(chain, T.StructType([*fields, T.StructField(SAME, T.BooleanType())]))
