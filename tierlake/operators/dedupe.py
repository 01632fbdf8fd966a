"""Key-based de-duplication.

``dropDuplicates`` keeps an arbitrary row per key. With ``order_by`` the kept
row is the first in a total order: the order columns, then every other
column, so ties can only be between identical rows.

The ordered form is ``row_number() OVER (PARTITION BY keys ORDER BY ...) =
1``. Spark plans it with a map-side ``WindowGroupLimit`` before the shuffle:
each map task keeps only its first row per key, so a key that holds a third
of all rows still sends one row per map task (like a partial aggregate),
and after the shuffle one sort per partition finishes the pick.

Both sorts hold whole rows. Text columns that follow one another in the order
are therefore carried through sorts and shuffle as one text (``packed``) that
compares like them: a row of many short texts otherwise takes 16 bytes or more
for each, whatever its length, and map tasks of a few million rows spill.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

# In a packed text each part ends with END; a NULL is the one character NULL,
# which sorts first. Characters of a part up to ESCAPE are written as ESCAPE
# and one more, in their own order.
NULL, END, ESCAPE = "\x00", "\x01", "\x02"
ESCAPED = {ESCAPE: ESCAPE + "\x05", END: ESCAPE + "\x04", NULL: ESCAPE + "\x03"}


def _sortable(df: DataFrame, name: str) -> Column:
    """The column, or its JSON text where its type holds a map (no order)."""
    return F.to_json(F.col(name)) if "map<" in df.schema[name].dataType.simpleString() \
        else F.col(name)


def order_names(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                rest: bool = True) -> list[str]:
    """Sort columns: ``order_by``, then (with ``rest``) all others but the keys."""
    order = [c for c in dict.fromkeys(order_by) if c not in keys]
    if rest:
        order += [c for c in df.columns if c not in keys and c not in order]
    return order


def _directed(df: DataFrame, names: Sequence[str], descending: bool) -> list[Column]:
    cols = [_sortable(df, c) for c in names]
    return [c.desc_nulls_last() if descending else c.asc_nulls_first() for c in cols]


def order_columns(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                  descending: bool = False, rest: bool = True) -> list[Column]:
    """``order_names`` as sort expressions."""
    return _directed(df, order_names(df, keys, order_by, rest), descending)


def _replaced(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


# Escapes are rare: both ways they are lambdas behind a test of the whole row,
# so that the code generated for other rows stays short enough to be compiled.

def packed(names: Sequence[str]) -> Column:
    """Text columns as one text that compares like them in turn, NULLs first."""
    cols = [F.col(c) for c in names]
    bare = F.concat_ws("", *cols)
    escaped = F.transform(F.array(*cols), lambda c: F.coalesce(_replaced(c, ESCAPED.items()),
                                                               F.lit(NULL)))
    return F.when(
        bare.contains(ESCAPE) | bare.contains(END) | bare.contains(NULL),
        F.concat_ws(END, escaped, F.lit("")),
    ).otherwise(F.concat_ws(END, *[F.coalesce(c, F.lit(NULL)) for c in cols], F.lit("")))


def unpacked(text: Column, position: int, nullable: bool = True) -> Column:
    """The column at a position (from 1) of a ``packed`` text."""
    # Unlike a split, this compares bytes and keeps those that are no UTF-8.
    part = F.substring_index(F.substring_index(text, END, position), END, -1)
    plain = F.transform(F.array(part), lambda c: _replaced(
        c, [(new, old) for old, new in reversed(ESCAPED.items())]))[0]
    value = F.when(text.contains(ESCAPE), plain).otherwise(part)
    return F.when(part != F.lit(NULL), value) if nullable else F.coalesce(value, F.lit(""))


def text_runs(df: DataFrame, order: Sequence[str]) -> list[list[str]]:
    """Two or more text columns (of binary order) that follow one another."""
    runs = [list(run) for text, run in
            groupby(order, lambda c: df.schema[c].dataType == StringType()) if text]
    return [run for run in runs if len(run) > 1]


def dedupe(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str] | None = None,
    descending: bool = False,
    rest: bool = True,
) -> DataFrame:
    """One row per key; NULL key parts compare equal (they form one group).

    ``order_by=None``: any row (``dropDuplicates``). ``order_by=[...]``: the
    first row by those columns then all others (ascending, NULLs first; or
    descending, NULLs last). ``order_by=[]`` orders by all non-key columns.
    ``rest=False`` orders by ``order_by`` alone, for columns that are unique
    within a key.
    """
    keys = list(keys)
    if order_by is None:
        return df.dropDuplicates(keys)
    order = order_names(df, keys, order_by, rest)
    if not order:
        return df.select(*keys).distinct()
    texts = {f"_dedupe_text_{k}": run for k, run in enumerate(text_runs(df, order))}
    place = {c: (text, i) for text, run in texts.items() for i, c in enumerate(run, 1)}
    slim = df.select(*[c for c in df.columns if c not in place],
                     *[packed(run).alias(text) for text, run in texts.items()])
    by = dict.fromkeys(place[c][0] if c in place else c for c in order)
    w = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(*_directed(slim, list(by), descending))
    first = slim.withColumn("_dedupe_rn", F.row_number().over(w)).where(F.col("_dedupe_rn") == 1)
    return first.select(*[
        unpacked(F.col(place[c][0]), place[c][1], df.schema[c].nullable)
        .alias(c, metadata=df.schema[c].metadata) if c in place else F.col(c)
        for c in df.columns])
