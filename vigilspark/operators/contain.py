"""Which texts contain which words: an equi-join on pieces of characters, not a test of every pair, unless the words are few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of pieces; a word goes by a piece of the largest length that fits into it.
PIECES = (8, 4, 2, 1)
#: Bytes up to which words are broadcast (as JSON, an upper estimate); larger dictionaries are shuffled.
MAX_BROADCAST_BYTES = 8 << 20
#: Up to so many rows of words each text is searched for each of them: that costs less than to cut it into pieces.
FEW_WORDS = 64


def _pieces(text: Column, n: int) -> Column:
    """Distinct pieces of n characters; the look-ahead reads a long text in one pass, as substrings by place wouldn't."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), 1))


def _fitting(word: Column, *each: Column) -> Column:
    """The one of ``each``, a column for every length in PIECES, that goes with the word."""
    return F.coalesce(*(F.when(F.length(word) >= n, x) for n, x in zip(PIECES, each)))


def rarest_piece(words: DataFrame, word: str, name: str) -> DataFrame:
    """``words`` with the piece of each word that the fewest words hold; null and empty words go."""
    own = _fitting(F.col("_word"), *(_pieces(F.col("_word"), n) for n in PIECES))
    pieces = words.where(F.length(word) > 0).select(F.col(word).alias("_word")).distinct().select("_word", F.explode(own).alias("_cut"))
    counts = pieces.groupBy("_cut").agg(F.count("*").alias("_n"))
    best = pieces.join(counts, "_cut").groupBy("_word").agg(F.min_by("_cut", F.struct("_n", "_cut")).alias(name))
    return words.join(best, F.col(word) == F.col("_word")).drop("_word")


def contained(texts: DataFrame, words: DataFrame, text: str, word: str, key: list[str] | None = None) -> DataFrame:
    """Rows of ``texts`` joined with the rows of ``words`` whose ``word`` the column ``text`` contains.

    Texts are cut into their distinct pieces and meet each word at its rarest piece; the whole word is
    checked then.  One look at the words tells whether they are so few that each is looked for by itself, which
    lengths of pieces they need and whether their bytes may be broadcast.  Beyond that both sides are shuffled by
    piece; with a ``key`` that names each text, only the key travels with the pieces, as fits long texts.  Null and
    empty words are in no text; repeated rows of either side repeat the pairs."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    words = words.where(F.length(word) > 0)
    seen = words.agg(size, F.collect_set(_fitting(F.col(word), *map(F.lit, PIECES))), F.count("*")).first()
    small, lengths = (seen[0] or 0) <= MAX_BROADCAST_BYTES, sorted(seen[1]) or [1]
    if small and seen[2] <= FEW_WORDS:
        return texts.join(F.broadcast(words), F.col(text).contains(F.col(word)))
    narrow = not small and key
    cut = texts.select(*(key if narrow else texts.columns), F.explode(F.concat(*(_pieces(F.col(text), n) for n in lengths))).alias("_piece"))
    met = cut.join(rarest_piece(words, word, "_piece").hint("broadcast" if small else "shuffle_hash"), "_piece").drop("_piece")
    met = texts.join(met, key) if narrow else met
    return met.where(F.col(text).contains(F.col(word)))
