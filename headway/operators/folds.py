"""Ordered folds that carry a state: over one array without copying its output at each step, and over blocks of a long history.

A fold is text of Spark SQL: ``s`` is the state before an element ``x``. States of few values compose: what a block does
to each of them is known before the state at its start is, so that no history is ever gathered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose output a fold collects before it is appended as a whole, at each of two levels.
CHUNK = 64


def folded(array: str, start: str, step: str, out: str, out_type: str, chunk: int = CHUNK) -> Column:
    """``out`` of each element of ``array`` in order, as one array: ``step`` gives the state after an element, ``out`` sees that too, as ``n``.

    ``array`` names a column. Appending to an array copies it, so elements are folded in chunks, chunks in chunks of
    chunks, and only those are appended to the whole: an element is copied about ``chunk`` times, and arrays of a
    million elements take a million times what one takes.
    """
    empty = f"cast(array() AS array<{out_type}>)"
    last, c = f"(size({array}) - 1)", chunk
    # states are wrapped in arrays of one, so that they have names and are computed once an element
    after = f"transform(array(a.s), s -> transform(array({step}), n -> named_struct('s', n, 'out', concat(a.out, array({out}))))[0])[0]"
    inner = f"aggregate(c, named_struct('s', element_at(r, -1).s, 'out', {empty}), (a, x) -> {after})"
    joined = "named_struct('s', element_at(r, -1).s, 'out', flatten(transform(r, q -> q.out)))"
    middle = f"aggregate(d, array(named_struct('s', element_at(w, -1).s, 'out', {empty})), (r, c) -> concat(r, array({inner})), r -> {joined})"
    # by index, as slice() would walk the whole array for each chunk
    chunks = f"transform(sequence(0, {last} div {c * c}), i -> transform(sequence(i * {c}, least(i * {c} + {c - 1}, {last} div {c})), j -> transform(sequence(j * {c}, least(j * {c} + {c - 1}, {last})), k -> {array}[k])))"
    whole = f"aggregate({chunks}, array(named_struct('s', {start}, 'out', {empty})), (w, d) -> concat(w, array({middle})), w -> flatten(transform(w, q -> q.out)))"
    return F.expr(f"CASE WHEN size({array}) > 0 THEN {whole} ELSE {empty} END")


def folded_in_blocks(rows: DataFrame, keys: list[str], block: Column, order: list[str], values: list[str], states: int, step: str, out: str, out_type: str) -> DataFrame:
    """``keys`` and the fields of ``out`` for each row of ``rows``, folded by ``keys`` in ``order`` from state 0.

    ``step`` maps a state ``s`` of ``0 .. states - 1`` and an element ``x`` (``order`` and ``values``) to the next.
    ``block`` never falls along the order. A block's rows are one array; it is followed from every state, those maps are
    put together along the blocks, and then each block is folded again from the state that it starts in.
    """
    runs = rows.groupBy(*keys, block.alias("block")).agg(F.sort_array(F.collect_list(F.struct(*order, *values))).alias("f"))
    follow = F.expr(f"transform(sequence(0, {states - 1}), e -> aggregate(f, e, (s, x) -> {step}))")
    maps = runs.select(*keys, "block", follow.alias("to")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", "to"))).alias("blocks"))
    starts = maps.select(*keys, F.inline(folded("blocks", "0", "x.to[s]", "named_struct('block', x.block, 'start', s)", "struct<block:bigint,start:int>")))
    met = runs.withColumn("block", F.col("block").cast("bigint")).join(starts, [*keys, "block"])
    return met.select(*keys, F.inline(folded("f", "start", step, out, out_type)))
