"""Byte-level BPE in columns: ranked merges folded over the bytes of distinct words, and decoding.

A text is cut into words by the tokenizer's pattern, and each word is encoded apart. The words of a corpus follow a power
law, so the most frequent ones are folded once each and sent to all tasks as a map; a word that is not among them is folded
where it stands. Ranks and words are looked up in arrays of small maps, as a map of Spark is searched from its first key on.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memengine.llm.common import cut, table

#: Small maps that ranks, and known words, are dealt to: a prime and a power of two.
RANK_MAPS, WORD_MAPS = 65_537, 1 << 17
#: Words that are folded once for all, and the bytes of the longest of them: at most so many are sent to tasks.
KNOWN, KNOWN_BYTES = 1 << 19, 64
#: White space of all scripts, as it stands inside brackets: Java's own class knows that of ASCII.
BLANK = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Words of more bytes are folded by replacing all pairs of the least rank at once.
LONG = 200
#: Ids are below SHIFT, whose last is an end mark; the rank of a pair that makes no token.
BITS = 20
SHIFT, NONE = 1 << BITS, 1 << 30


def long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


@dataclass
class Ranks:
    """A byte-level vocabulary as columns: ``pairs`` has the id that two ids merge to, ``of_byte`` a byte's id, ``pieces``
    each id's bytes as characters U+0000 to U+00FF."""

    pairs: Column
    of_byte: Column
    pieces: Column

    def merged(self, left: Column, right: Column) -> Column:
        """The id of both pieces together, which is also the rank of their merge; NONE if they make no token."""
        key = left * long(SHIFT) + right
        return F.coalesce(F.element_at(F.get(self.pairs, F.pmod(key, F.lit(RANK_MAPS)).cast("int")), key), long(NONE))


def constant(value: DataFrame, name: str) -> Column:
    """The one value of a table as a literal, which is one block of memory: it passes through a session variable, as
    higher-order functions take no subquery. Columns that are made of it keep the value when the name gets another."""
    spark, name = value.sparkSession, f"bpe_{name}"
    spark.sql(f"DECLARE OR REPLACE VARIABLE {name} {value.schema[0].dataType.simpleString()}")
    spark.sql(f"SET VARIABLE {name} = (SELECT * FROM {{value}})", value=value)
    return F.col(f"system.session.{name}")


def from_python(spark: SparkSession, value: object, kind: str, shape: Callable[[Column], Column] = lambda v: v) -> Column:
    text = json.dumps({"v": value})
    return constant(spark.createDataFrame([(text,)], "v string").select(shape(F.from_json("v", f"v {kind}")["v"]).alias("v")), hashlib.sha256(text.encode()).hexdigest()[:16])


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from lines of base64 and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def load(spark: SparkSession, ranks: dict[bytes, int]) -> Ranks:
    """All ways to make a token of two tokens; every byte must be a token, and ranks are the ids."""
    maps: list[dict] = [{} for _ in range(RANK_MAPS)]
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                key = left * SHIFT + right
                maps[key % RANK_MAPS][key] = rank
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.decode("latin-1")
    pairs = [[{"key": k, "value": v} for k, v in m.items()] for m in maps]
    as_maps = from_python(spark, pairs, "array<array<struct<key:bigint,value:bigint>>>", lambda v: F.transform(v, F.map_from_entries))
    return Ranks(as_maps, F.array(*(F.lit(ranks[bytes([b])]) for b in range(256))), from_python(spark, pieces, "array<string>"))


def split_words(text: Column, pattern: str) -> Column:
    """All matches of the pattern, in order; a null text has none. White space is Unicode's, written out where a class has it."""
    parts = re.split(r"(\[[^]]*\])", pattern)
    wide = "".join(p.replace(r"\s", BLANK) if p.startswith("[") else p.replace(r"\s", f"[{BLANK}]").replace(r"\S", f"[^{BLANK}]") for p in parts)
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(wide), F.lit(0))


def _bytes(word: Column, ranks: Ranks) -> Column:
    return F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), lambda c: F.get(ranks.of_byte, F.ascii(c)))


def _one_by_one(word: Column, ranks: Ranks) -> Column:
    """The first pair of the least rank is merged, again and again. The state has a number for each id, the rank of its merge
    with its right neighbour times SHIFT plus the id, and an end mark on both sides; a merge changes two of them."""

    def packed(rank: Column, of: Column) -> Column:
        return rank * long(SHIFT) + of

    def merge(e: Column, m: Column, p: Column) -> Column:
        made = F.shiftright(m, BITS)
        before = let(F.get(e, p - 2).bitwiseAND(long(SHIFT - 1)), lambda x: packed(ranks.merged(x, made), x))
        behind = packed(ranks.merged(made, F.get(e, p + 1).bitwiseAND(long(SHIFT - 1))), made)
        return F.concat(F.slice(e, F.lit(1), p - 2), F.array(before, behind), F.slice(e, p + 2, F.size(e)))

    def step(e: Column, _: Column) -> Column:
        return let(F.array_min(e), lambda m: F.when(m >= long(NONE * SHIFT), e).otherwise(let(F.array_position(e, m).cast("int"), lambda p: merge(e, m, p))))

    end = F.array(long(SHIFT - 1))
    ids = F.concat(end, _bytes(word, ranks).cast("array<bigint>"), end)
    start = let(ids, lambda x: F.transform(x, lambda v, i: packed(F.coalesce(ranks.merged(v, F.get(x, i + 1)), long(NONE)), v)))
    return F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), start, step, lambda e: F.transform(F.slice(e, F.lit(2), F.size(e) - 2), lambda x: x.bitwiseAND(long(SHIFT - 1)).cast("int")))


def _all_at_once(word: Column, ranks: Ranks) -> Column:
    """The same ids for a long word: each pass replaces all pairs that are equal to the first of the least rank.

    That is the order of single merges, since in a vocabulary whose tokens encode to themselves a merge makes no pair of a
    lower rank. The state is text, ``<12><7>``, so a pass takes time in proportion to it.
    """

    def ids(s: Column) -> Column:
        return F.split(F.btrim(s, F.lit("<>")), "><").cast("array<int>")

    def best(x: Column) -> Column:
        return F.array_min(F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.struct(ranks.merged(F.get(x, i).cast("long"), F.get(x, i + 1)).alias("r"), i.alias("i"), F.get(x, i).alias("a"), F.get(x, i + 1).alias("b"))))

    def step(s: Column, _: Column) -> Column:
        def merged(b: Column) -> Column:
            ended = b["r"] == NONE
            text = F.when(ended, s["s"]).otherwise(F.replace(s["s"], F.format_string("<%d><%d>", b["a"], b["b"]), F.format_string("<%d>", b["r"])))
            return F.struct(text.alias("s"), ended.alias("end"))

        return F.when(s["end"], s).otherwise(let(let(ids(s["s"]), best), merged))

    text = F.concat(F.lit("<"), F.array_join(_bytes(word, ranks).cast("array<string>"), "><"), F.lit(">"))
    return F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), F.struct(text.alias("s"), F.lit(False).alias("end")), step, lambda s: ids(s["s"]))


def encode_word(word: Column, ranks: Ranks) -> Column:
    """The ids of one match of the pattern."""
    return F.when(F.octet_length(word) > LONG, _all_at_once(word, ranks)).otherwise(_one_by_one(word, ranks))


def _place(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(long(WORD_MAPS - 1)).cast("int")


def known_words(docs: DataFrame, ranks: Ranks, pattern: str, known: int, name: str) -> Column:
    """An array of maps from words to ids, of the corpus's most frequent words: at most ``known``, as few as equal counts leave.

    Counts fall into levels, 16 for each power of two; the words of the lowest levels that do not fit as a whole stay out.
    """
    level = F.floor(F.log2("n") * 16)
    counts = docs.select(F.explode(split_words(F.col("text"), pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = cut(counts.filter((F.col("n") > 1) & (F.octet_length("word") <= KNOWN_BYTES)).select("word", level.alias("level")))
    lowest, total = 1 << 20, 0
    for r in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r["level"]):  # about 700 levels at most
        total += r["count"]
        if total > known:
            break
        lowest = r["level"]
    maps = counts.filter(F.col("level") >= lowest).select(_place(F.col("word")).alias("at"), "word", encode_word(F.col("word"), ranks).alias("ids"))
    maps = maps.groupBy("at").agg(F.collect_list(F.struct("word", "ids")).alias("entries"))
    every = counts.sparkSession.range(WORD_MAPS).select(F.col("id").cast("int").alias("at")).join(maps, "at", "left")
    return constant(every.agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "entries"))), lambda x: F.map_from_entries(x["entries"])).alias("words")), name)


def encode(docs: DataFrame, ranks: Ranks, pattern: str, known: int = KNOWN) -> DataFrame:
    """The rows of ``docs`` with ``ids``, the token ids of the whole text; a null or empty text has none.

    Each match of the pattern is encoded apart, as the tiktoken library does. ``ids`` takes the place of a column of that
    name; rows that repeat, null ids and empty tables are as any other. Java's classes of characters decide, which know
    Unicode 13 in Java 17: of a character assigned later the pattern takes no letter or digit.
    """
    name = uuid.uuid4().hex
    dictionary = known_words(docs, ranks, pattern, known, name)

    def of(word: Column) -> Column:
        return F.coalesce(F.element_at(F.get(dictionary, _place(word)), word), encode_word(word, ranks))

    found = docs.withColumn("ids", F.flatten(F.transform(split_words(F.col("text"), pattern), of)))
    docs.sparkSession.sql(f"DROP TEMPORARY VARIABLE bpe_{name}")  # the plan has the words
    return found


def decode(ids: Column, ranks: Ranks) -> Column:
    """The bytes of all ids' pieces, one after the other; they need not be whole characters. An id without a piece has no bytes."""
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(ranks.pieces, i)), ""), "ISO-8859-1")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = load(spark, read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    found = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2(decode(F.col("ids"), ranks), 256).alias("decoded_sha256"))
