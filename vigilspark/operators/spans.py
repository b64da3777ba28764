"""Where the words of a dictionary stand in texts, and which of them get their place.

One pass of an automaton over each text finds every word of the dictionary, so time follows the texts and what
they hold, not the size of the dictionary.  Who takes which span is decided by functions of Spark."""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.operators.contain import contained

#: Bytes of a dictionary (as JSON) that go to every executor as one automaton; a larger one meets the texts by a join first.
MAX_AUTOMATON_BYTES = 4 << 20


def occurrences(df: DataFrame, text: str, words: DataFrame, name: str, left: bool = True, right: bool = True, most: int = MAX_AUTOMATON_BYTES) -> DataFrame:
    """``df`` with ``name``: (start, end, word, other columns of ``words``) of every ``word`` in the column ``text``.

    Places count characters from 0.  ``left`` and ``right`` ask for no letter, digit or underscore on that side.  Case
    counts.  Null texts and words have none; repeated rows of ``words`` repeat the occurrences.  Beyond ``most`` bytes a text's
    own words are found by an equi-join on pieces, and the automaton is that of the text."""
    words = words.where(F.length("word") > 0)
    schema = words.schema
    ddl = "array<struct<start:int,end:int," + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in schema) + ">>"
    at = schema.names.index("word")

    def automaton(table):
        import ahocorasick

        found = ahocorasick.Automaton()
        rows: dict[str, list[int]] = {}
        for i, word in enumerate(table.column(at).to_pylist()):
            rows.setdefault(word, []).append(i)
        for word, which in rows.items():
            found.add_word(word, (len(word), which))
        found.make_automaton()
        return found

    def spans(text, found, out):
        inside = lambda c: c.isalnum() or c == "_"
        for end, (length, which) in found.iter(text):
            start, end = end - length + 1, end + 1
            if left and start and inside(text[start - 1]) or right and end < len(text) and inside(text[end]):
                continue
            for i in which:
                out.append((start, end, i))

    def packed(each, table):
        """A list of (start, end, row of ``table``) a text, as one array."""
        flat = [x for one in each for x in one]
        start, end, which = (pa.array([x[k] for x in flat], pa.int32()) for k in range(3))
        offsets = pa.array([0, *accumulate(len(one) for one in each)], pa.int32())
        columns = [table.column(k).combine_chunks().take(which) if isinstance(table, pa.Table) else table.column(k).take(which) for k in range(table.num_columns)]
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([start, end, *columns], names=["start", "end", *table.schema.names]))

    size = words.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    if size <= most:
        held = df.sparkSession.sparkContext.broadcast(words.toArrow())
        built: list = []  # the worker's own

        @F.arrow_udf(ddl)
        def find(texts: pa.Array) -> pa.Array:
            if not built:
                built.append(automaton(held.value))
            each = [[] for _ in range(len(texts))]
            if held.value.num_rows:
                for text, out in zip(texts.to_pylist(), each):
                    if text:
                        spans(text, built[0], out)
            return packed(each, held.value)

        return df.withColumn(name, find(F.col(text)))

    # The words of each distinct text travel with it.
    own = contained(df.select(F.col(text).alias("_text")).distinct(), words, "_text", "word", ["_text"]).groupBy("_text").agg(
        F.collect_list(F.struct(*schema.names)).alias("_words"))

    @F.arrow_udf(ddl)
    def find_own(texts: pa.Array, given: pa.Array) -> pa.Array:
        table = pa.RecordBatch.from_struct_array(given.flatten())
        each, row = [], 0
        for text, rows in zip(texts.to_pylist(), given):
            out = []
            n = len(rows) if rows.is_valid else 0
            if text and n:
                part: list = []
                spans(text, automaton(table.slice(row, n)), part)
                out = [(a, b, i + row) for a, b, i in part]
            row += n
            each.append(out)
        return packed(each, table)

    return df.join(own, F.col(text) == F.col("_text"), "left").withColumn(name, find_own(F.col(text), F.col("_words"))).drop("_text", "_words")


def allocated(spans: Column, order, value, cap: int) -> Column:
    """The spans that get their place: in ``order(span)`` each word takes its first free occurrence, until ``cap`` different
    ``value(span)`` are there.  What is taken isn't free for the words that follow."""
    sorted_ = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(order(s).alias("o"), s.word.alias("w"), s.start.alias("a"), s.alias("s")))), lambda x: x.s)

    def step(taken, s):
        free = ~F.exists(taken, lambda t: (t.word == s.word) & value(t).eqNullSafe(value(s)) | (t.start < s.end) & (s.start < t.end))
        wanted = F.size(F.array_distinct(F.transform(taken, value))) < cap
        return F.when(free & wanted, F.concat(taken, F.array(s))).otherwise(taken)

    return F.aggregate(sorted_, F.slice(spans, 1, 0), step)


def longest_first(span) -> Column:
    return -F.length(span.word)
